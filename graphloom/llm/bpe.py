"""Byte-level BPE: speculate and verify.

A word's tokens are proposed by greedy longest match against the vocabulary. A token sequence is the
BPE encoding exactly if every adjacent pair is: merging the pair's bytes gives the same two tokens.
So the pairs of all proposals of a batch are checked at once against arrays of known good and bad
pairs (a new pair is decided once by exact merging), and only words with a bad pair are merged
exactly. Words are found by the tokenizer's split pattern; special strings become their ids.

Decoding joins the tokens' bytes and reads them as UTF-8, broken sequences replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import ship, texts
from graphloom.llm.textbatch import _LIVE, Dictionary, chunks, expand, flat, slices, sums

#: Pairs of tokens that a worker remembers at most.
PAIRS = 4_000_000
#: The split of byte-level BPE (fixed by the tokenizer format); white space is Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_letters() -> dict[str, int]:
    """The format's letter for each byte: printable Latin-1 itself, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    other = (b for b in range(256) if b not in set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBPE:
    """A byte-level BPE tokenizer from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters = byte_letters()
        self.vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        name = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[name[a], name[b]] = rank, name[a + b]
        self.byte_id = [self.vocab.get(bytes([b])) for b in range(256)]
        self.longest = max(map(len, self.vocab))
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take in their neighbours")
        self.specials = specials
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.split = regex.compile(SPLIT)
        size = max([*self.vocab.values(), *specials.values()]) + 1
        spelled = {i: t for t, i in self.vocab.items()} | {i: t.encode() for t, i in specials.items()}
        lens = np.array([len(spelled.get(i, b"")) for i in range(size)], np.int64)
        self.token_len, self.token_at = lens, np.cumsum(lens) - lens
        self.token_bytes = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(size)), np.uint8)
        self.spelled, self.size = spelled, size
        self.clear()
        _LIVE.append(self)
        self._library = None
        self._path = path

    def clear(self) -> None:
        """Forget which pairs hold."""
        self.good, self.bad = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the best-ranked pair merges first, the leftmost of equals."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) < 2:
            return ids
        get, n = self.merges.get, len(ids)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = get((a, b))[1], -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := get((ids[i], ids[k])):
                    heappush(heap, (m[0], i, ids[i], ids[k]))
            h = left[i]
            if h >= 0 and (m := get((ids[h], ids[i]))):
                heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def greedy(self, word: bytes) -> list[int]:
        """The longest vocabulary entry at each position."""
        whole = self.vocab.get(word)
        if whole is not None:
            return [whole]
        get, n, at, out = self.vocab.get, len(word), 0, []
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                token = get(word[at:to])
                if token is not None:
                    out.append(token)
                    at = to
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (first id * size + second id; a lone token t is t * size + t's own mark -1) holds."""
        distinct, back = np.unique(pairs, return_inverse=True)
        new = distinct[~np.isin(distinct, self.good) & ~np.isin(distinct, self.bad)]
        if len(new):
            if len(self.good) + len(self.bad) > PAIRS:  # bounds memory only: pairs are decided anew
                self.clear()
                new = distinct
            held = []
            for code in new.tolist():
                a, b = divmod(code, self.size + 1)
                held.append(self.merge(self.spelled[a]) == [a] if b == self.size else self.merge(self.spelled[a] + self.spelled[b]) == [a, b])
            held = np.array(held, bool)
            self.good, self.bad = np.union1d(self.good, new[held]), np.union1d(self.bad, new[~held])
        return np.isin(distinct, self.good)[back]

    def words(self, distinct: list[bytes]) -> list[list[int]]:
        """The ids of each word: proposed, checked, and merged exactly where the check fails."""
        out = [self.greedy(w) for w in distinct]
        lens = np.fromiter(map(len, out), np.int64, len(out))
        ids = np.fromiter((i for x in out for i in x), np.int64, int(lens.sum()))
        last = np.zeros(len(ids), bool)
        last[np.cumsum(lens) - 1] = True
        follow = np.append(ids[1:], 0)
        # a token stands alone in the last place: it must be its own encoding, as in every pair
        held = self.compatible(ids * (self.size + 1) + np.where(last, self.size, follow))
        failed = np.unique(np.repeat(np.arange(len(out)), lens)[~held])
        for k in failed.tolist():
            out[k] = self.merge(distinct[k])
        self.exact = len(failed)
        return out

    def split_words(self, chunk: str) -> list[str]:
        if chunk.isascii() or max(chunk) < "\u0250":
            return self.split.findall(chunk)
        if self._library is None:  # the library's own tables say what is a letter in other scripts
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [chunk[a:b] for _, (a, b) in self._library.pre_tokenize_str(chunk)]

    def encode(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunks, the number for each, and their order (as given)."""
        number: dict[bytes, int] = {}
        rows: list[int] = []
        per = np.zeros(len(new), np.int64)
        fixed: dict[int, int] = {}
        for k, raw in enumerate(new):
            chunk, before = raw.decode(), len(rows)
            parts = [chunk]
            if self.special is not None and any(s in chunk for s in self.specials):
                parts, at = [], 0
                for m in self.special.finditer(chunk):
                    parts += [chunk[at : m.start()], self.specials[m.group()]]
                    at = m.end()
                parts.append(chunk[at:])
            for part in parts:
                if isinstance(part, int):
                    fixed[len(rows)] = part
                    rows.append(0)
                elif part:
                    rows += [number.setdefault(w.encode(), len(number)) for w in self.split_words(part)]
            per[k] = len(rows) - before
        got = self.words(list(number)) or [[]]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((i for x in got for i in x), np.uint32, int(lens.sum()))
        at = np.cumsum(lens) - lens
        row = np.array(rows, np.int64)
        each = lens[row]
        if fixed:
            places = np.array(list(fixed))
            ids, row_at = np.append(ids, np.array(list(fixed.values()), np.uint32)), at[row]
            row_at[places], each[places] = len(ids) - len(fixed) + np.arange(len(fixed)), 1
        else:
            row_at = at[row]
        return ids[expand(row_at, each)], sums(each, per), np.arange(len(new))

    def spell(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids of each document stand for, and their number."""
        lens = self.token_len[ids]
        return self.token_bytes[expand(self.token_at[ids], lens)], sums(lens, per)


_made: dict[str, tuple[ByteBPE, Dictionary]] = {}


def made(path: str) -> tuple[ByteBPE, Dictionary]:
    if path not in _made:
        bpe = ByteBPE(path)
        _made[path] = bpe, Dictionary(bpe.encode, chunks)
    return _made[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id, ids (little-endian unsigned 32-bit integers) and the text decoded from them.

    Null text counts as empty: no ids, empty decoded text. Rows are independent; repeated and null
    doc_ids give a row each, and other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = made(path)
        for batch in slices(batches, "text"):
            ids, per = known.encoded(*flat(batch.column("text")))
            spelled, lens = bpe.spell(ids, per)
            raw, id_ends = ids.astype("<u4").tobytes(), 4 * np.append(0, np.cumsum(per))
            text, ends = spelled.tobytes(), np.append(0, np.cumsum(lens))
            cells = [raw[a:b] for a, b in zip(id_ends[:-1], id_ends[1:], strict=True)]
            back = [text[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(per.astype(np.int64)), pa.array(cells, pa.binary()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode_decode`` with digests taken in the same task."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = made(path)
        for batch in slices(batches, "text"):
            ids, per = known.encoded(*flat(batch.column("text")))
            spelled, lens = bpe.spell(ids, per)
            raw, id_ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.append(0, np.cumsum(per))
            text, ends = spelled.tobytes(), np.append(0, np.cumsum(lens))
            of_ids = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(id_ends[:-1], id_ends[1:], strict=True)]
            of_text = [hashlib.sha256(text[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(per.astype(np.int64)), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
