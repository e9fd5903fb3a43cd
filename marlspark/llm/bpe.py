"""BPE encoding and decoding with a byte-level vocabulary, merged in batched numpy rounds.

Words of many documents lie in one flat array of symbols.  In each round the rank of every adjacent pair is
found by binary search over the sorted pair keys, each word's lowest-ranked pair is merged wherever it occurs
in the word, and words without a mergeable pair leave the array.

Defined results: a null text counts as empty and has no tokens; a very long text is handled whole; repeated rows
each get their own result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches_by_bytes, prepared

#: How byte-level BPE cuts text into words (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept in a worker's memory before it starts anew.
MOST_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, chars = model["vocab"], byte_symbols()
        self.first = np.array([ids[c] for c in chars], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        left, right, made = [], [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(ids[a])
            right.append(ids[b])
            made.append(ids[a + b])
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)
        of = {c: b for b, c in enumerate(chars)}
        size = max([*ids.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in ids.items():
            pieces[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one flat array, and each word's count of ids."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        out_ids, out_word = [], []
        none = np.int64(len(self.rank))

        def ranks(at: np.ndarray) -> np.ndarray:
            """The rank of the pair that begins at each position; ``none`` where the word ends or no merge exists."""
            ok = at + 1 < len(sym)
            ok[ok] = word[at[ok]] == word[at[ok] + 1]
            inside, found = at[ok], np.full(len(at), none)
            key = (sym[inside] << 32) | sym[inside + 1]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found[ok] = np.where(self.keys[pos] == key, self.rank[pos], none)
            return found

        pair = ranks(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[:-1] != word[1:]]))
            best = np.minimum.reduceat(pair, starts)
            count = np.diff(np.append(starts, len(sym)))
            over = best == none
            if over.any():
                done = np.repeat(over, count)
                out_ids.append(sym[done])
                out_word.append(word[done])
                sym, word, pair = sym[~done], word[~done], pair[~done]
                best, count = best[~over], count[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(pair == np.repeat(best, count))
            # occurrences that overlap (as in "aaa") are taken from the left, every other one of a run
            new_run = np.concatenate([[True], np.diff(at) != 1])
            at = at[((at - at[new_run][np.cumsum(new_run) - 1]) & 1) == 0]
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            sym, word, pair = sym[keep], word[keep], pair[keep]
            # only pairs that a merge touched have another rank now
            touched = np.unique(np.concatenate([moved, np.maximum(moved - 1, 0)]))
            pair[touched] = ranks(touched)
        if not out_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, of = np.concatenate(out_ids), np.concatenate(out_word)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        n = self.piece_len[ids]
        total = int(n.sum())
        shift = np.repeat(self.piece_at[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if total else np.zeros(0, np.int64)
        return self.piece_bytes[np.arange(total) + shift].tobytes().decode("utf-8", "replace")


class Encoder:
    """Encodes texts; words met before in this task are looked up, the new ones of a batch are merged together."""

    def __init__(self, vocabulary: Vocabulary, special_as_text: bool = False):
        self.v = vocabulary
        self.words = regex.compile(PATTERN).findall
        specials = [] if special_as_text else sorted(vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.n = np.zeros(1 << 16, np.int64), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        for token, i in self.v.special.items():
            self._put([token], np.array([i]), np.array([1]), special=True)

    def _put(self, words: list[str], ids: np.ndarray, counts: np.ndarray, special: bool = False) -> None:
        k, m = len(self.index), len(words)
        while k + m > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.n + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n : self.n + len(ids)] = ids
        self.start[k : k + m] = self.n + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.count[k : k + m] = counts
        self.n += len(ids)
        for i, w in enumerate(words):
            self.index[("\0special", w) if special else w] = k + i

    def _split(self, text: str) -> list:
        if self.cut is None or not any(t in text for t in self.v.special):
            return self.words(text)
        out: list = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(("\0special", part))
            else:
                out += self.words(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > MOST_WORDS:
            self.clear()
        cut = [self._split(t) for t in texts]
        new = list({w for words in cut for w in words if w not in self.index})
        if new:
            self._put(new, *self.v.encode_words([w.encode() for w in new]))
        out = []
        get = self.index.__getitem__
        for words in cut:
            at = np.fromiter(map(get, words), np.int64, len(words))
            n = self.count[at]
            total = int(n.sum())
            shift = np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if total else np.zeros(0, np.int64)
            out.append(self.ids[np.arange(total) + shift])
        return out


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text; the strings of special tokens get their ids."""

    def run(batches):
        encoder = Encoder(Vocabulary(vocabulary))
        for b in batches_by_bytes(batches, 1, 4 << 20):
            ids = encoder.encode(b.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return prepared(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids count as none."""

    def run(batches):
        v = Vocabulary(vocabulary)
        for b in batches_by_bytes(batches, 1, 4 << 20):
            texts = [v.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, in one pass without a shuffle."""

    def run(batches):
        v = Vocabulary(vocabulary)
        encoder = Encoder(v)
        decimal = np.array([str(i).encode() for i in range(len(v.piece_len))], object)
        sha = hashlib.sha256
        for b in batches_by_bytes(batches, 1, 4 << 20):
            n, a, d = [], [], []
            for ids in encoder.encode(b.column(1).fill_null("").to_pylist()):
                n.append(len(ids))
                a.append(sha(b",".join(decimal[ids].tolist())).hexdigest())
                d.append(sha(v.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return prepared(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

