import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, token_binary, words
from ledgerloom.llm.queries import tokenizer

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
TEXTS = ["", " ", "  a", "a  b", "a\n\n b", "x<|endoftext|>y <|endoftext|>", "<|ENDOFTEXT|> <|startoftext|>a", "tab\there\x0bx", "I'm don't 'S they'll. it's,", "日本語 テキスト　x ÀÉ", "é é \xa0b ́", "a \x1c b\x1c", "ΑΣ ΣΑΣ. İI. İ",
         "12345 67 ½", "🙂🙂 x", "z" * 3000, "The the THE. the, ß. ñ, Ÿ. ×. a.b,", None]


def texts():
    draw = random.Random(4)
    return TEXTS + ["".join(draw.choice("ab e\n'st.1é中 \t<|endoftext|>XYZ!?#́ΣİK,") for _ in range(draw.randint(0, 60))) for _ in range(500)]


def library(name):
    return tokenizers.Tokenizer.from_file(tokenizer(name))


def test_trie_bpe():
    own, lib = bpe.coder(tokenizer(BYTE)), library(BYTE)
    ts = [t or "" for t in texts()]
    want = [e.ids for e in lib.encode_batch(ts, add_special_tokens=False)]
    assert own.encode_batch(ts) == want
    assert [own.decode(x) for x in want] == [lib.decode(x, skip_special_tokens=False) for x in want] == ts
    assert own.decode([255, 130]) == lib.decode([255, 130], skip_special_tokens=False)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit("x")})


def test_bpe_frames(spark):
    rows = list(enumerate(texts())) + [(0, "again"), (None, "none")]
    df, lib = frame(spark, rows), library(BYTE)
    got = bpe.round_trip_digests(df, tokenizer(BYTE)).collect()
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, len(ids(t)), sha(",".join(map(str, ids(t)))), sha(t or ""))) for i, t in rows)
    back = bpe.decode_frame(bpe.encode_frame(df, tokenizer(BYTE)), tokenizer(BYTE)).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, t or "")) for i, t in rows)
    assert bpe.checked_frame(df, tokenizer(BYTE)).where("not round_trip").count() == 0
    assert bpe.round_trip_digests(df.limit(0), tokenizer(BYTE)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 130, 5000, 70_000])
def test_rans_round_trip(n):
    draw = np.random.default_rng(n)
    for ids in (draw.zipf(1.3, n).clip(1, 60_000).astype(np.uint32), np.full(n, 7, np.uint32), draw.integers(0, 200_000, n, dtype=np.uint32)):
        f = token_binary.encode_frame(ids)
        assert (token_binary.decode_frame(f["symbols"], f["freqs"], f["blocks"]) == ids).all()
    if n > 64:
        f["blocks"][0]["words"] = f["blocks"][0]["words"][:-4] + b"\1\2\3\4"
        with pytest.raises((ValueError, IndexError)):
            token_binary.decode_frame(f["symbols"], f["freqs"], f["blocks"])


def test_word_tokenizer():
    own, lib = token_binary.WordTokenizer(tokenizer(WORD)), library(WORD)
    ts = texts()
    for size in (1, 40, len(ts)):
        for i in range(0, len(ts), size)[:60] if size == 1 else range(0, len(ts), size):
            flat, sizes = own.encode(pa.array(ts[i : i + size], pa.string()), 1)
            assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [lib.encode(t or "", add_special_tokens=False).ids + [1] for t in ts[i : i + size]]


def test_words_that_share_a_hash(monkeypatch):
    """Words whose hashes fall together still get their own ids."""
    monkeypatch.setattr(words, "span_hashes", lambda data, starts, ends, lower=False: (ends - starts).astype(np.uint64))
    own, lib, ts = token_binary.WordTokenizer(tokenizer(WORD)), library(WORD), texts()
    for i in range(0, len(ts), 50):
        flat, sizes = own.encode(pa.array(ts[i : i + 50], pa.string()), 1)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [lib.encode(t or "", add_special_tokens=False).ids + [1] for t in ts[i : i + 50]]


def test_token_files(spark, tmp_path, monkeypatch):
    rows = [(3 * i - 100, t) for i, t in enumerate(texts())] + [(None, "first"), (-100, "tie")]
    lib, at, want = library(WORD), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    token_binary.write_tokens(frame(spark, rows).repartition(3), str(tmp_path / "t"), tokenizer(WORD))
    assert sorted((tuple(r) for r in token_binary.read_tokens(spark, str(tmp_path / "t"), digest=True).collect()), key=lambda r: r[1]) == want
    full = token_binary.read_tokens(spark, str(tmp_path / "t")).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == dict((w[1], w[3]) for w in want)[r.start] for r in full)
    token_binary.write_tokens(frame(spark, []), str(tmp_path / "e"), tokenizer(WORD))
    assert token_binary.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_word_hashes():
    import re

    ts = [None, "", "a b", "A b\tc", "x" * 3_000_000, "y " + "x" * 3_000_000 + " z", "é\x0bü\xa0q"]
    for lower in (False, True):
        h, at = words.hashed(pa.array(ts).slice(1), lower)
        seen = {}
        for i, t in enumerate(ts[1:]):
            ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" and lower else c for c in t))
            assert len(ws) == at[i + 1] - at[i]
            for w, v in zip(ws, h[at[i] : at[i + 1]].tolist()):
                assert seen.setdefault(w, v) == v
        assert len(set(seen.values())) == len(seen)
