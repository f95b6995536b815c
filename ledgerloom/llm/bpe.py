"""Byte-level BPE by a traversal of the trie of distinct words.

The encoding of a byte string by BPE is fixed by the *last token* of each of
its prefixes: if the last token of ``w[:i]`` is ``t``, the encoding of
``w[:i]`` is that of ``w[:i - len(t)]`` followed by ``t``.  And ``t`` is the
one token that ends ``w[:i]`` and may follow the last token of the prefix
before it, where "may follow" (the two encode to just themselves when joined)
depends on the two tokens only.  So the distinct words of a batch are put in
sorted order, which is the depth-first order of their trie; the stack of
last-token states is cut back to the prefix that a word shares with the one
before it and extended over its own bytes alone.  Shared prefixes are encoded
once, and no merge loop runs over a word.

Documents are read where they lie: a narrow map without any shuffle, with
bounded tables of words already encoded in each Python worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.held import held, uncollected

#: How the byte-level pre-tokenizer cuts text into words: a fixed value of the tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Entries after which a worker forgets its words (bounds its memory; never a result).
MAX_WORDS, MAX_PAIRS = 250_000, 500_000
DOCS_AT_ONCE, CHARS_AT_ONCE = 4096, 6_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieBPE:
    """Encoder and decoder for one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        raw = {s: bytes(alphabet[c] for c in s) for s in spec["model"]["vocab"]}
        self.ids = {raw[s]: i for s, i in spec["model"]["vocab"].items()}
        self.text_of = {i: b for b, i in self.ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(self.ids[raw[a]], self.ids[raw[b]]): (r, self.ids[raw[a] + raw[b]]) for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.heads: dict[str, tuple[int, ...] | None] = {}
        self.after_space: dict[str, tuple[int, ...] | None] = {}
        # A vocabulary entry that merges never build can't end a prefix.
        self.whole = {b: i for b, i in self.ids.items() if self.merged(b) == [i]}

    def merged(self, word: bytes) -> list[int]:
        """The plain merge loop; for vocabulary entries and pairs of them only."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(out) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(out, out[1:])) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            out[k : k + 2] = [self.rank[out[k], out[k + 1]][1]]
        return out

    def may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.text_of[a] + self.text_of[b]) == [a, b]
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words by one depth-first walk over their trie."""
        out, whole, text_of, longest, pairs, may_follow = {}, self.whole, self.text_of, self.longest, self.pairs, self.may_follow
        before, last, path = b"", [-1], [()]  # state and encoding of each prefix of the current branch
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], path[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                    token = whole.get(word[j:i])
                    if token is not None:
                        if j == 0:
                            break
                        ok = pairs.get((last[j], token))
                        if may_follow(last[j], token) if ok is None else ok:
                            break
                last.append(token)
                path.append((j, token))
            tokens, i = [], len(word)
            while i:
                j, token = path[i]
                tokens.append(token)
                i = j
            out[word] = tuple(reversed(tokens))
            before = word
        return out

    def _words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """A table with the encodings of these words at least."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        new = {w.encode(): w for w in words if w not in self.words}
        self.words |= {new[b]: ids for b, ids in self.encode_words(new).items()}
        return self.words

    def _learn(self, texts: list[str]) -> None:
        """Encode all stretches of the texts that this worker hasn't met yet."""
        if len(self.after_space) + len(self.heads) > MAX_WORDS:
            self.after_space.clear(), self.heads.clear()
        heads, rest = set(), set()
        for t in texts:
            first, *others = t.split(" ")
            heads.add(first)
            rest.update(others)
        heads = {h: WORDS.findall(h) for h in heads if h not in self.heads}
        rest = {p: None if not p or p[0].isspace() or p[-1].isspace() else WORDS.findall(" " + p) for p in rest if p not in self.after_space}
        get = self._words({w for ws in chain(heads.values(), rest.values()) if ws for w in ws}).__getitem__
        together = lambda ws: get(ws[0]) if len(ws) == 1 else tuple(chain.from_iterable(map(get, ws)))
        self.heads |= {h: None if h and h[-1].isspace() else together(ws) for h, ws in heads.items()}
        self.after_space |= {p: None if ws is None else together(ws) for p, ws in rest.items()}

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens whose stretches are known."""
        first, *others = text.split(" ")
        parts = [self.heads[first], *map(self.after_space.__getitem__, others)]
        if None in parts:  # runs of white space: cut the whole text, since stretches aren't independent
            words = WORDS.findall(text)
            return list(chain.from_iterable(map(self._words(set(words)).__getitem__, words)))
        return list(chain.from_iterable(parts))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, special tokens recognised, none added."""
        pieces = [self.cut_special.split(t) if self.cut_special else [t] for t in texts]
        self._learn([p for ps in pieces for p in ps if p and p not in self.special])
        out = []
        for ps in pieces:
            ids: list[int] = []
            for p in ps:
                if p in self.special:
                    ids.append(self.special[p])
                elif p:
                    ids += self._plain(p)
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


def coder(path: str) -> TrieBPE:
    return held(TrieBPE, path)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) in pieces of bounded size; a longer text comes alone."""
    with uncollected():
        for batch in batches:
            ids, column, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                texts, chars, start = [], 0, at
                while at < batch.num_rows and len(texts) < DOCS_AT_ONCE and chars < CHARS_AT_ONCE:
                    texts.append(column[at].as_py() or "")
                    chars += len(texts[-1])
                    at += 1
                yield ids[start:at], texts


def encode_frame(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` with the ids of every whole text; null text encodes as empty.

    One output row per input row in any case: repeated rows, empty tables and
    further columns need no special treatment."""

    def run(batches):
        bpe = coder(path)
        for ids, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(bpe.encode_batch(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def checked_frame(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip``: as ``encode_frame``, and whether the ids decode to the very text.

    A row for each row, repeated ones and those with a null id too; a null or
    empty text has no ids, and texts of any length are encoded whole."""

    def run(batches):
        bpe = coder(path)
        for ids, texts in slices(batches):
            coded = bpe.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in coded], pa.int64()), pa.array(coded, pa.list_(pa.int32())),
                                              pa.array([bpe.decode(x) == t for x, t in zip(coded, texts, strict=True)], pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode_frame(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from an ids column; null ids decode to an empty text."""

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col]).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text and return digests of both directions.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``; a null text is empty."""

    def run(batches):
        bpe, sha = coder(path), hashlib.sha256
        names: dict[int, str] = {}
        name = lambda i: names.get(i) or names.setdefault(i, str(i))
        for ids, texts in slices(batches):
            coded = bpe.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([
                ids,
                pa.array([len(x) for x in coded], pa.int64()),
                pa.array([sha(",".join(map(name, x)).encode()).hexdigest() for x in coded], pa.string()),
                pa.array([sha(bpe.decode(x).encode()).hexdigest() for x in coded], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
