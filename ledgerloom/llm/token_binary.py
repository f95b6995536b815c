"""Token ids as binary files: static range asymmetric numeral systems (rANS).

File format.  A file set is a Parquet folder; Parquet is only the container, so
that any store Spark writes to will do and a lost task is written again.  One
row is a *frame* of whole documents:

``part, frame``   position in the global order (part, then frame)
``first``         ids in this part before the frame
``doc_ids, lens`` the documents of the frame and how many ids each has
``symbols, freqs`` the frequency table that all blocks of the frame share:
                  the ids in use (uint32, little endian) and their shares of 2**20
``blocks``        independent blocks of up to 2**20 ids: ``n``, ``states`` (the
                  checkpoint: one uint64 for each interleaved coder), ``words``
                  (the coded uint32 words) and ``crc`` (CRC-32 of the block's
                  ids as little-endian uint32)

Within a block, id number i belongs to coder i mod K; the K coders advance
together, one numpy step for K ids, and share one word stream in the order in
which a reader needs it.  Each frame carries its own table, so one pass writes
the files and any block is decoded alone.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import words
from ledgerloom.llm.held import held

SCALE, LOW = 20, 31  # bits of the frequency scale; a state lies in [2**LOW, 2**(LOW + 32))
BLOCK, LANES, FRAME = 1 << 20, 4096, 1 << 22
MAX_WORDS, WORDS_AT_ONCE, TEXT_AT_ONCE = 3_000_000, 1000, 12 << 20
BLOCK_TYPE = pa.struct([("n", pa.int32()), ("states", pa.binary()), ("words", pa.binary()), ("crc", pa.int64())])
FRAME_TYPE = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("lens", pa.list_(pa.int64())), ("symbols", pa.binary()), ("freqs", pa.binary()), ("blocks", pa.list_(BLOCK_TYPE))])
FRAME_DDL = ("part int, frame int, first long, n_tokens long, doc_ids array<long>, lens array<long>, symbols binary, freqs binary, "
             "blocks array<struct<n:int,states:binary,words:binary,crc:long>>")


def shares(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to whole shares of 2**SCALE, at least 1 each."""
    f = 1 + counts.astype(np.int64) * ((1 << SCALE) - len(counts)) // max(1, int(counts.sum()))
    f[np.argmax(counts)] += (1 << SCALE) - f.sum()
    return f.astype(np.uint64)


def encode_block(s: np.ndarray, f: np.ndarray, c: np.ndarray) -> tuple[bytes, bytes]:
    """States and words of one block; ``s`` indexes the table of shares ``f`` and their running sum ``c``."""
    lanes = max(1, min(LANES, len(s) // 64))
    x, out = np.full(lanes, 1 << LOW, np.uint64), []
    up, low, half = np.uint64(SCALE), np.uint64(32), np.uint64(LOW + 32 - SCALE)
    for t in range((len(s) - 1) // lanes, -1, -1):
        row = s[t * lanes : (t + 1) * lanes]
        y, fs = x[: len(row)], f[row]
        full = y >= fs << half
        out.append(y[full].astype(np.uint32))
        y = np.where(full, y >> low, y)
        q = y // fs
        x[: len(row)] = (q << up) + (y - q * fs) + c[row]
    return x.astype("<u8").tobytes(), np.concatenate(out[::-1]).astype("<u4").tobytes()


def decode_block(n: int, states: bytes, words: bytes, f: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Table indexes of one block; ``at`` is the index of each of the 2**SCALE slots."""
    x, w = np.frombuffer(states, "<u8").astype(np.uint64), np.frombuffer(words, "<u4")
    lanes, out, used = len(x), np.empty(n, at.dtype), 0
    up, low, mask, floor = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1), np.uint64(1 << LOW)
    for t in range(0, n, lanes):
        m = min(lanes, n - t)
        y = x[:m]
        slot = y & mask
        s = at[slot]
        out[t : t + m] = s
        y = f[s] * (y >> up) + slot - c[s]
        need = np.flatnonzero(y < floor)
        y[need] = (y[need] << low) | w[used : used + len(need)]
        used += len(need)
        x[:m] = y
    if used != len(w) or (x != floor).any():
        raise ValueError("a block's words don't fit its checkpoint")
    return out


def encode_frame(ids: np.ndarray) -> dict:
    """Frequency table and blocks of a run of ids."""
    top = int(ids.max()) + 1 if len(ids) else 0
    counts = np.bincount(ids, minlength=top) if top else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    if not len(symbols):
        return {"symbols": b"", "freqs": b"", "blocks": []}
    f = shares(counts[symbols])
    c = np.cumsum(f, dtype=np.uint64) - f
    place = np.zeros(top, np.int32)
    place[symbols] = np.arange(len(symbols))
    blocks = []
    for i in range(0, len(ids), BLOCK):
        part = ids[i : i + BLOCK]
        states, words = encode_block(place[part], f, c)
        blocks.append({"n": len(part), "states": states, "words": words, "crc": zlib.crc32(part.astype("<u4").tobytes())})
    return {"symbols": symbols.astype("<u4").tobytes(), "freqs": f.astype("<u4").tobytes(), "blocks": blocks}


def decode_frame(symbols: bytes, freqs: bytes, blocks: list[dict]) -> np.ndarray:
    """All ids of a frame, each block checked against its checksum."""
    if not blocks:
        return np.zeros(0, np.uint32)
    ids, f = np.frombuffer(symbols, "<u4"), np.frombuffer(freqs, "<u4").astype(np.uint64)
    c = np.cumsum(f, dtype=np.uint64) - f
    at = np.repeat(np.arange(len(f), dtype=np.uint16 if len(f) < 1 << 16 else np.uint32), f.astype(np.int64))
    out = []
    for b in blocks:
        part = ids[decode_block(b["n"], b["states"], b["words"], f, c, at)]
        if zlib.crc32(part.astype("<u4").tobytes()) != b["crc"]:
            raise ValueError("a block's ids don't match its checksum")
        out.append(part)
    return np.concatenate(out)


#: Bytes with A-Z in lower case.
SMALL = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class WordTokenizer:
    """The library's encoding of texts, asked for each distinct word of a worker once.

    For a tokenizer that drops white space, never joins across it and folds
    case.  Words are told apart by a 64-bit hash that folds ASCII case too; a full stop
    or comma behind a letter is a word of its own, since it encodes alone as it
    does there.  Only texts with what could be a special token, whose case
    counts, are hashed by their exact bytes.  Known words are arrays: sorted
    hashes, where in ``tokens`` the ids of each begin and end, and its bytes.
    Every word that is looked up is compared with them, so texts in which two
    words share a hash go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        model = json.loads(self.tokenizer.to_str())["model"]
        mark, self.ends = model.get("end_of_word_suffix"), None
        if mark:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(True), bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.end, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.spelt, self.length, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column, ``end`` after each text's, and how many each text has."""
        data, starts, ends, bounds = words.parsed(column)
        raw = data.tobytes()
        if len(starts):
            last, before, ahead = data[ends - 1], data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
            letter = ((before | 32) >= 97) & ((before | 32) <= 122) & (ends - starts > 1)
            letter |= (ahead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (ends - starts > 2)
            cut = ends[((last == 44) | (last == 46)) & letter] - 1
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        exact = b"<|" in raw
        h = words.span_hashes(data, starts, ends, lower=not exact) ^ np.uint64(0x94D049BB133111EB * exact)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > MAX_WORDS:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(np.append(self.hashes, ~distinct[-1:])[at] != distinct) if len(distinct) else np.zeros(0, np.int64)
        if len(new):
            where = first[new]
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], exact)
            at = np.searchsorted(self.hashes, distinct)
        if not self.same(data, starts, ends - starts, at[which], exact):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.array([*x, end], np.uint32) for x in ids]), np.array([len(x) + 1 for x in ids], np.int64)
        size = (self.end - self.begin)[at][which]
        text = np.searchsorted(bounds[1:], starts, "right")  # of each word
        place = np.cumsum(size) - size + text
        out = np.full(int(size.sum()) + len(column), end, np.uint32)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(place, size) + step] = self.tokens[np.repeat(self.begin[at][which], size) + step]
        return out, np.bincount(text, size, len(column)).astype(np.int64) + 1

    def same(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, known: np.ndarray, exact: bool) -> bool:
        """Whether all words are spelt as the known ones that they were taken for, but for ASCII case unless ``exact``."""
        if (sizes != self.length[known]).any():
            return False
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mine = data[np.repeat(starts, sizes) + step]
        return bool(((mine if exact else SMALL[mine]) == self.letters[np.repeat(self.spelt[known], sizes) + step]).all())

    def _learn(self, hashes: np.ndarray, raw: list[bytes], exact: bool) -> None:
        """Ask the library for new words; those of letters alone go many in one text, where each ends with a token that ends a word."""
        texts = [w.decode() for w in raw]
        ids: list = [None] * len(texts)
        plain = [k for k, w in enumerate(texts) if w.isalpha() and max(w) < "\u0130"] if self.ends is not None else []
        for i in range(0, len(plain), WORDS_AT_ONCE):
            some = plain[i : i + WORDS_AT_ONCE]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[k] for k in some)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) == len(some):  # else they are asked one by one
                for k, x in zip(some, np.split(got, stops[:-1]), strict=True):
                    ids[k] = x
        rest = [k for k, x in enumerate(ids) if x is None]
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                ids[k] = np.array(e.ids, np.uint32)
        stop = np.cumsum([len(x) for x in ids]) + len(self.tokens)
        begin = np.concatenate([[len(self.tokens)], stop[:-1]])
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = np.concatenate([self.hashes, hashes])[order]
        self.begin, self.end = np.concatenate([self.begin, begin])[order], np.concatenate([self.end, stop])[order]
        self.tokens = np.concatenate([self.tokens, *ids])
        length = np.array([len(w) for w in raw], np.int64)
        spelt = np.cumsum(length) - length + len(self.letters)
        self.spelt, self.length = np.concatenate([self.spelt, spelt])[order], np.concatenate([self.length, length])[order]
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(raw if exact else [w.lower() for w in raw]), np.uint8)])


def word_tokenizer(path: str) -> WordTokenizer:
    return held(WordTokenizer, path)


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending order of id.

    A null text has only the end id; null ids come first; rows of equal id are
    ordered by their text; an empty table writes files without frames."""

    def run(batches):
        tokens, part = word_tokenizer(tokenizer_path), TaskContext.get().partitionId()
        frame, first, held, ids, lens = 0, 0, [], [], []

        def flush():
            nonlocal frame, first, held, ids, lens
            flat = np.concatenate(held)
            row = {"part": part, "frame": frame, "first": first, "n_tokens": len(flat), "doc_ids": ids, "lens": lens} | encode_frame(flat)
            frame, first, held, ids, lens = frame + 1, first + len(flat), [], [], []
            return pa.RecordBatch.from_pylist([row], schema=FRAME_TYPE)

        for batch in words.text_slices(batches, 1, TEXT_AT_ONCE):
            flat, sizes = tokens.encode(batch.column(1), end_id)
            held.append(flat)
            ids += batch.column(0).to_pylist()
            lens += sizes.tolist()
            if sum(map(len, held)) >= FRAME:
                yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, FRAME_DDL).write.option("compression", "uncompressed").parquet(out)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Decode a file set: ``doc_id, start, n_tokens`` and the ``ids``, or with ``digest`` their ``ids_crc32``.

    ``start`` counts the ids of all documents before; only one number for each
    written part goes through the driver to find it."""
    files = spark.read.schema(FRAME_DDL).parquet(path)
    starts, total = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        starts[r.part], total = total, total + r.n
    last = ("ids_crc32", "long") if digest else ("ids", "array<long>")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, lens = decode_frame(row["symbols"], row["freqs"], row["blocks"]), np.array(row["lens"], np.int64)
                ends = np.cumsum(lens)
                begin = starts[row["part"]] + row["first"]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    col = pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lens.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    col = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begin + ends - lens), pa.array(lens), col], ["doc_id", "start", "n_tokens", last[0]])

    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}")
