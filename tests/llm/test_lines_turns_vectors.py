"""Line quality, turn repair and whitening against brute force, with odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import line_quality, turn_repair, whitening

FOLDER = "/root/testdata/sf0.01"


# ---- turn repair


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit: rows are (role, text, fault)."""
    best = None

    def go(k, cost, audit, out, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows):
            roles = "".join(r[:1] for r, _ in out)
            body = roles[1:] if roles[:1] == "s" else roles
            legal = not roles or body and body == "ua" * (len(body) // 2)
            if legal and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, [f"{r}:{t}" for r, t in out]
        else:
            role, text, fault = rows[k]
            late = fault == "truncated"
            go(k + 1, cost + 3, audit + "D", out, inserts)
            if fault not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a"):
                    go(k + 1, cost + late, audit + "K", [*out, (role, text)], inserts)
                for new in ("user", "assistant"):
                    go(k + 1, cost + 2 + late, audit + "R", [*out, (new, text)], inserts)
        if inserts:
            for new in ("user", "assistant"):
                go(k, cost + 2, audit + "I", [*out, (new, "")], inserts - 1)

    go(0, 0, "", [], 3)
    return best


def expected(rows):
    """The contract for one conversation's (turn, role, text) before damage, by plain loops."""
    live = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        live += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in live if t is not None]
    faults, seen = [], set()
    for _, role, text in live:
        bare = text.strip(" \t\n\r\x0b\x0c")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(live, live[1:])]
    cost, audit, repaired = cheapest([(r, x, f) for (_, r, x), f in zip(live, faults)])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, repaired


def test_turn_repair_equals_trying_every_edit(spark):
    rng, rows = random.Random(5), []
    for conv in range(120):
        for k in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = rng.choice(["Yes.", "No!", "Why", " \n", None, "", "Long. " * 50, f"text {k}?", "é 日本。", "Done. \t"])
            rows.append((conv, rng.choice([k, k, k, k + 2, None]), role, text, "x", 1))
    rows += [(None, 0, "user", "A.", "x", 1), (None, 1, "assistant", "B.", "x", 1), *[(500, k, "user", "One.", "x", 1) for k in range(3)]]
    found = turn_repair.repair(turn_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string, n int").repartition(3)))
    got = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    assert got.keys() == by.keys()
    for conv, own in by.items():
        assert got[conv] == expected(own), conv
    assert any(g[-1] == [] for g in got.values()) and len({g[6] for g in got.values()}) > 30


def test_turn_repair_of_long_and_empty_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert turn_repair.repair(turn_repair.damage(spark.createDataFrame([], kind))).collect() == []
    long = [(1, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(1500)]
    got = turn_repair.repair(turn_repair.rows_of(spark.createDataFrame(long[:700] + long[701:], kind))).first()
    assert (got["gaps"], got["illegal"], got["cost"]) == (1, 1, 2) and got["audit"].count("I") == 1 and len(got["repaired"]) == 1500
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turn_repair.repair(turn_repair.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], kind))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", [])]


def test_turn_repair_query_on_its_table(spark):
    from tidemark.llm import queries

    by = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        by.setdefault(r["conv_id"], []).append((r["conv_id"], r["turn"], r["role"], r["text"]))
    got = queries.op12_turn_repair(spark, FOLDER).collect()
    assert len(got) == len(by)
    for r in got:
        if len(by[r["conv_id"]]) <= 5:
            *counts, repaired = expected(by[r["conv_id"]])
            assert tuple(r)[1:] == (*counts, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


# ---- line quality


def test_messages_equal_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2, 5]
    starts, pairs = np.concatenate([[0], np.cumsum(sizes)]), rng.normal(size=(2, 2))
    odds = rng.normal(size=sum(sizes))
    found = line_quality.sigmoid(sum(line_quality.messages(odds, pairs, starts)))
    for a, n in zip(starts, sizes):
        weight = {y: np.exp(odds[a : a + n] @ y + sum(pairs[i, j] for i, j in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=n)}
        for k in range(n):
            assert found[a + k] == pytest.approx(sum(w for y, w in weight.items() if y[k]) / sum(weight.values()), abs=1e-12)


def test_features_equal_plain_loops():
    import pyarrow as pa

    lines = ["", "A b. B!! ** é", "   ", "the the the", "One, two", "x1 $ 22!", "\x0bA"]
    found = line_quality.features(pa.array(["skipped", *lines])[1:])
    for row, line in zip(found, lines):
        words, solid = line.split(), "".join(line.split()).encode()
        caps, small = sum(65 <= c <= 90 for c in solid), sum(97 <= c <= 122 or c >= 128 for c in solid)
        assert row[3] == pytest.approx(caps / max(caps + small, 1)) and row[5] == pytest.approx(sum(48 <= c <= 57 for c in solid) / max(len(solid), 1))
        assert row[12] == pytest.approx((len(words) - len(set(words))) / max(len(words), 1)) and row[13] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / max(len(words) - 1, 1))
        assert row[14] == (bool(words) and words[-1][-1] in ".,;:?'\"()-!") and row[15] == (not words)
        assert row[11] == pytest.approx(sum(w[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for w in words) / max(len(words), 1))
        assert row[8] == pytest.approx(sum(w[-1] in "*$" for w in words) / max(len(words), 1))


def test_quality_of_unseen_texts(spark):
    from tidemark.llm import queries

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = queries.op11_line_quality(spark, FOLDER).collect()
    assert len(got) == 1000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    unseen = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in unseen) >= 0.95 * len(unseen) > 50
    assert all(r["predicted"] for r in unseen if labels[r["doc_id"]])


def test_quality_is_the_weighted_mean_of_marginals(spark):
    model = line_quality.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    texts = ["One line of words.\nTHE!! LOUD!! ONE!!\n\nmore of it, and more.", None, "", "a" * 300_000, "x y\n" * 30_000, "One line of words.\nTHE!! LOUD!! ONE!!\n\nmore of it, and more."]
    rows = spark.createDataFrame([(k, t, "old", 5) for k, t in enumerate(texts)], "doc_id int, text string, score string, Own int")
    got = line_quality.score(rows, model).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "Own", "quality", "score", "predicted"} and got[0]["score"] == pytest.approx(got[5]["score"], abs=1e-12)
    assert got[1]["score"] == got[2]["score"] and all(0 <= r["score"] <= 1 for r in got)
    import pyarrow as pa

    lines = texts[0].split("\n")
    marginals = model.marginals(line_quality.features(pa.array(lines)), np.array([0, 4]))
    weights = [len(x) + 1 for x in lines]
    assert got[0]["quality"] == pytest.approx(float(marginals @ weights) / sum(weights)) and marginals[0] > marginals[1] and marginals[3] > 0.5


def test_quality_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "A text."), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in line_quality.score(docs, line_quality.fit(docs, none)).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (7, 0), (2, None)], "doc_id long, quality int")
    model = line_quality.fit(docs, ones)
    assert {r["score"] for r in line_quality.score(docs, model).collect()} == {1.0}
    assert line_quality.score(docs.limit(0), model).collect() == []


# ---- whitening


def plain_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    y = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(y.T @ y / len(x))
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return x, y @ axes / np.sqrt(values), values


@pytest.mark.parametrize("dims", [5, 40, 70])
def test_whitening_equals_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = (rng.normal(size=(300, dims)) * np.linspace(1, 3, dims)).astype(np.float32).tolist()
    vectors += vectors[:40] + vectors[:1] * 60
    odd = [None, [], [1.0] * (dims + 1), [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [None] * dims]
    rows = [(k, v, 3) for k, v in enumerate(vectors + odd)]
    ints = whitening.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").repartition(5))
    model = whitening.fit(ints)
    got = whitening.by_component(ints, model).collect()
    x, white, values = plain_whitening(vectors)
    k = min(dims, 32)
    assert len(got) == len(vectors) * k and {r["n"] for r in got} == {len(vectors)} and all(r["identity_error"] < 1e-9 for r in got)
    mine = np.zeros((len(vectors), k))
    for r in got:
        mine[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.var(x, axis=0).sum(), rel=1e-9)
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-8
    sums, n = [int(s) for s in x.sum(axis=0)], len(x)
    exact = {i: sum((n * int(a) - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert all(r["deviation"] == exact[r["vec_id"]] for r in got)


def test_whitening_of_few_and_constant_vectors(spark):
    kind = "vec_id string, embedding array<double>"
    none = whitening.integers(spark.createDataFrame([], kind))
    assert whitening.by_component(none, whitening.fit(none)).collect() == []
    for vectors, full in (([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0, 2.0], [3.0, 2.0], [1.0, 2.0]], 1)):
        rows = whitening.integers(spark.createDataFrame([(None, v) for v in vectors], kind))
        got = whitening.by_component(rows, whitening.fit(rows)).collect()
        assert len(got) == 2 * len(vectors) and sum(r["whitened"] is not None for r in got) == full * len(vectors)
        assert all(r["explained"] is None for r in got) if not full else all(r["identity_error"] < 1e-9 for r in got)
    with pytest.raises(Exception, match="too large"):
        whitening.fit(whitening.integers(spark.createDataFrame([("a", [1e30])], kind)))


def test_deviations_beyond_a_long_are_null():
    model = whitening.Model(10**9, [10**15 + 7, 3 * 10**14], np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[1_000_000, 300_000], [1_000_003, 300_001], [2_000_000_000, 0]])
    assert model.deviations(x) == [49, (3 * 10**9 - 7) ** 2 + 10**18 if (3 * 10**9 - 7) ** 2 + 10**18 < 2**63 else None, None]
