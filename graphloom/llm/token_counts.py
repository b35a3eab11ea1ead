"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches hold about the same number of bytes whatever the number of rows. Texts are cut at safe
boundaries before encoding. For a ``tokenizers`` file whose normaliser and splitter never look past
ASCII white space (lower case, NFC, white space dropped), a cut before white space is safe: no
token, no composed character and no special string spans it. A long text thus becomes many small
pieces, equal pieces are encoded once, and the counts of a text's pieces add up. A ``sentencepiece``
model joins words over spaces, so its texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ship, texts
from graphloom.llm.textbatch import DISTINCT_BYTES, Dictionary, flat, pieces, slices

LIMIT = 2048
_made: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer as the file gives it, but without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def cuts_at_space(tok) -> bool:
    """Whether white space always separates tokens and never becomes part of one.

    Read from the specification: the normaliser has only steps that never look past ASCII white space,
    the splitter keeps the matches of a pattern that can't match any, and special strings have none.
    Probes of the tokenizer itself confirm it: white space alone gives no token, case is dropped, and
    a full stop or comma ends a word.
    """
    spec = json.loads(tok.to_str())
    if not (_steps(spec.get("normalizer"), "normalizers", _normalises_words) and _splits_at_space(spec.get("pre_tokenizer"))):
        return False
    lone = not tok.encode(" \t\n\r\x0b\x0c", add_special_tokens=False).ids
    kept = any(x.lstrip or x.rstrip or " " in x.content for x in tok.get_added_tokens_decoder().values())
    ids = lambda x: tok.encode(x, add_special_tokens=False).ids
    apart = ids("ab \n cd") == ids("ab") + ids("cd") and ids("Ab.") == ids("ab") + ids(".") and ids("aB,") == ids("ab") + ids(",")
    return lone and not kept and apart and bool(tok.get_added_tokens_decoder())


def _steps(spec: dict | None, inner: str, allowed) -> bool:
    if spec is None:
        return True
    return all(_steps(x, inner, allowed) for x in spec[inner]) if spec["type"] == "Sequence" else allowed(spec)


def _normalises_words(step: dict) -> bool:
    """Unicode forms, lower case, and runs of white space made one space."""
    return step["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents") or (step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " ")


def _splits_at_space(spec: dict | None) -> bool:
    """Whether the first step keeps just the matches of a pattern in which nothing matches white space."""
    steps = (spec or {}).get("pretokenizers", [spec] if spec else [])
    if not steps or steps[0]["type"] != "Split" or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
        return False
    pattern = steps[0]["pattern"].get("Regex", " ")
    negated = re.findall(r"\[\^([^\]]*)\]", pattern)
    rest = re.sub(r"\[\^[^\]]*\]", "", pattern)
    later = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x.get("use_regex") for x in steps[1:])
    return later and all(r"\s" in x for x in negated) and not re.search(r"\\[sWDP]|[ .\t\n]", rest)


def plain_only(path: str):
    """The tokenizer for words that normalising and splitting leave as they are, without those steps.

    None if it does not give the same ids as the whole tokenizer.
    """
    from tokenizers import pre_tokenizers

    whole, bare = tokenizer(path), tokenizer(path)
    bare.normalizer = None
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    probe = ["a", "word", "straße", "été", "ñandú", "internationalisation"]
    same = all(bare.encode(w, add_special_tokens=False).ids == whole.encode(w, add_special_tokens=False).ids for w in probe)
    return bare if same else None


def is_plain(word: str) -> bool:
    """Lower-case Latin letters only, composed."""
    return word.isalpha() and word.islower() and (word.isascii() or (max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)))


def joined(path: str):
    """Batch encoding of many pieces: joined by a special string, whose id marks the ends.

    Plain words go to the tokenizer without its normaliser and splitter; pieces that hold a part of a
    special string are encoded one by one.
    """
    tok, bare = tokenizer(path), plain_only(path)
    mark, text = min((i, x.content) for i, x in tok.get_added_tokens_decoder().items() if x.special)

    def run(t, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = t.encode_batch_fast([text.join(words[i : i + 500]) for i in range(0, len(words), 500)], add_special_tokens=False)
        ids = np.concatenate([np.array(x, np.uint32) for r in runs for x in (r.ids, [mark])] or [np.zeros(0, np.uint32)])
        return ids[ids != mark], np.diff(np.append(-1, np.flatnonzero(ids == mark))) - 1

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [x.decode() for x in new]
        group: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, w in enumerate(words):
            group[0 if bare is not None and is_plain(w) else 2 if "<" in w or "|" in w or ">" in w else 1].append(k)
        single = [tok.encode(words[k], add_special_tokens=False).ids for k in group[2]]
        alone = np.array([i for x in single for i in x], np.uint32), np.array([len(x) for x in single], np.int64)
        parts = [run(bare, [words[k] for k in group[0]]), run(tok, [words[k] for k in group[1]]), alone]
        ids, lens = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        return ids, lens, np.array(group[0] + group[1] + group[2], np.int64)

    return encode


def dictionary(path: str) -> Dictionary:
    """The worker's dictionary of encoded pieces for a tokenizer that ``cuts_at_space``."""
    if path not in _made:
        if not cuts_at_space(tokenizer(path)):
            raise ValueError(f"{path}: its tokens can span white space")
        _made[path] = Dictionary(joined(path), pieces)
    return _made[path]


def _whole(path: str):
    """A function from texts to token counts, without cutting."""
    if path not in _made:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _made[path] = lambda xs: [len(x) for x in model.encode(xs, num_threads=1)]
        else:
            tok = tokenizer(path)
            _made[path] = lambda xs: [len(x.ids) for x in tok.encode_batch_fast(xs, add_special_tokens=False)]
    return _made[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty (0 bytes, 0 tokens); repeated and null doc_ids give a row each; other
    columns are not read. ``limit`` is the threshold of over_limit (more than).
    """
    ship(docs.sparkSession)
    cut = path.endswith(".json") and cuts_at_space(tokenizer(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", DISTINCT_BYTES):
            column = batch.column("text")
            data, offsets = flat(column)
            if cut:
                n = dictionary(path).lengths(data, offsets)
            else:
                n = np.array(_whole(path)(column.to_pylist()), np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n.astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = texts(docs).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
