"""Token files: wide ids, damage, ratio, other tokenizers, repeated and missing ids, and the registered query."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

SPEC = "word_bpe_49k.json"


def spec_of(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@pytest.mark.parametrize("kinds", [3, 20_000, 70_000])
def test_frames_hold_any_unsigned_ids_and_find_every_damaged_byte_tried(kinds):
    from tidemark.llm import token_files

    rng = np.random.default_rng(kinds)
    ids = (rng.zipf(1.2, 90_000) % kinds) * 60_013 % (1 << 32)
    frame = token_files.write_frame([1, 2], np.array([len(ids), 0]), ids)
    docs, lengths, back = token_files.read_frame(frame)
    assert docs == [1, 2] and lengths.tolist() == [len(ids), 0] and (back == ids).all()
    for at in rng.integers(0, len(frame), 12).tolist():
        damaged = bytearray(frame)
        damaged[at] ^= 1 << int(rng.integers(0, 8))
        with pytest.raises(ValueError):
            token_files.read_frame(bytes(damaged))
    for cut in (1, len(frame) // 2, len(frame) - 40):
        with pytest.raises(ValueError):
            token_files.read_frame(frame[:-cut])


def test_carries_are_settled():
    """Ids at the top of their interval again and again, and long runs, as both make carries likely."""
    from tidemark.llm import token_files

    for seed in range(20):
        rng = np.random.default_rng(seed)
        ids = np.where(rng.random(6000) < 0.98, 5, rng.integers(0, 3000, 6000))
        assert (token_files.read_frame(token_files.write_frame([1], np.array([6000]), ids))[2] == ids).all()


def test_the_mixed_orders_beat_deflate_on_the_same_blocks():
    from tidemark.llm import token_files

    rng = np.random.default_rng(5)
    phrases = [rng.zipf(1.3, 12) % 3000 for _ in range(400)]
    ids = np.concatenate([phrases[k] if k < 400 else rng.zipf(1.3, 12) % 3000 for k in rng.integers(0, 700, 20_000)])
    raw = ids.astype("<u2").tobytes()
    size = 2 * token_files.BLOCK
    assert len(token_files.write_frame([1], np.array([len(ids)]), ids)) < sum(len(zlib.compress(raw[k : k + size])) for k in range(0, len(raw), size))


def test_word_ids_are_those_of_the_library(monkeypatch):
    from tokenizers import Tokenizer

    from tidemark.llm import token_files

    monkeypatch.setattr(token_files, "KEPT", 60)
    rng, spec = random.Random(7), spec_of(SPEC)
    pieces = ["the", "Thé", "ÀB", "é", "́x", " ", "  ", "\n", " ", "　", ".", ",", "'s", "'", "12", "x9", "<|", "|>", "<|endoftext|>", "ß", "÷", "×", "İ", "日本", "🙂", "a.b", "\x1c", "\x85", "--", "***"]
    words, library = token_files.WordIds(spec), Tokenizer.from_str(spec)
    assert words.by_words
    for turn in range(60):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        if turn % 2:
            texts = [t.replace("<|", "<") for t in texts]
        ids, sizes = words.encode(pa.array(texts), 1)
        expected = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert sizes.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_case_and_marks_make_no_new_words_to_encode():
    """op3's CPU time: a word goes to the library once, whatever its case and the marks behind it."""
    from tokenizers import Tokenizer

    from tidemark.llm import token_files

    spec = spec_of(SPEC)
    words, library = token_files.WordIds(spec), Tokenizer.from_str(spec)

    def checked(texts):
        ids, sizes = words.encode(pa.array(texts), 1)
        expected = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert sizes.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]

    checked(["study study&&& Study,%%%", "STUDY*** study.\nstudy!! study***", "", "***"])
    assert sorted(filter(None, words.words.to_pylist())) == sorted(["study", "&&&", ",%%%", "***", ".", "!!"])
    checked(["ÉTUDE&&& Étude'. étude's. É.É,, à÷÷ à÷. ß×", "study<|endoftext|>&&& Study<|. <|&&& 12,,, ٣.. e\u0301!! \u0301!! a'!'s'", "'s' 's. ''s,"])


def test_the_bytes_of_frames_stay():
    """Files written earlier must still be read: these sums are of frames that the first coder of this format wrote."""
    from tidemark.llm import token_files

    at = np.arange(60_000, dtype=np.int64)
    for kinds, size, total in ((900, 68_702, 481_368_103), (40_000, 172_145, 2_373_937_069)):
        ids = (at * at // 7 + at // 50) % np.where(at % 3, 90, kinds)
        frame = token_files.write_frame([1], np.array([len(ids)]), ids)
        assert (len(frame), zlib.crc32(frame)) == (size, total)


def test_another_tokenizer_gets_whole_texts():
    from tokenizers import Tokenizer

    from tidemark.llm import token_files

    spec = spec_of("byte_bpe_50k.json")
    words, library = token_files.WordIds(spec), Tokenizer.from_str(spec)
    assert not words.by_words
    texts = ["Two  spaces\nand a line.", "", "é<|endoftext|>x"]
    ids, sizes = words.encode(pa.array(texts), 0)
    assert ids.tolist() == [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 0]] and len(sizes) == 3


def test_repeated_and_missing_document_ids(spark):
    from tidemark.llm import token_files

    rows = [(5, "b b", "x"), (None, "n", "x"), (5, "a", "x"), (7, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, payload string")
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.read(token_files.write(df, spec_of(SPEC), end=1)).orderBy("start").collect()]
    assert got == [(None, 0, 2), (5, 2, 2), (5, 4, 3), (7, 7, 1)]


def test_the_query_over_the_smallest_tables(spark):
    from tokenizers import Tokenizer

    from tidemark.llm import queries

    folder = "/root/testdata/sf0.001"
    library, start = Tokenizer.from_str(spec_of(SPEC)), 0
    got = {r["doc_id"]: r for r in queries.op3_token_files(spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        assert got[row["doc_id"]][1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
