"""Token ids of whole texts by the tokenizers library, many texts at once, with small caches.

A text is cut before each single space that stands between two characters other than white space;
no pre-tokenizer pattern used here joins pieces across such a place, so a text's ids are its chunks'
ids in a row. Arrow splits the texts of a slice and numbers their distinct chunks; each of these is looked up or
encoded once, and NumPy puts their ids in the order of the texts. New chunks are cut into pieces by the vocabulary's
own pattern, and new pieces go through the library's model. A vocabulary of another kind, texts that may hold an added token,
and chunks of scripts whose case or normal form the library may treat in its own way go through the library's
encode as they are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import _U, run_hashes

#: Chunks that a table holds at most, and pieces that a dict does: about 40 and 5 MB. Full, they start anew.
TABLE_CHUNKS = 800_000
CACHE_PIECES = 20_000
#: Bytes of longer chunks, which are encoded each time.
TABLE_BYTES = 48
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4_000_000
#: Chunks with letters beyond these take the library's own path.
LAST_PLAIN = "\u024f"
#: White space before a space, white space at the end.
_GAP = r"^ | $|[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_encoders: dict[str, Encoder] = {}
#: Fixed value: the pattern that the library's byte-level pre-tokenizer uses.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(others)}


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for n[0] numbers, then those from start[1], and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Table:
    """Ids of chunks in NumPy arrays, found by a hash of the chunk and told by its bytes.

    A chunk takes about 50 bytes, a fifth of what it takes in a dict.
    """

    def __init__(self, compute):
        self.compute = compute
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int32)
        self.keys, self.entry = np.zeros(0, _U), none
        self.text, self.text_at, self.text_n = np.zeros(0, np.uint8), none, none
        self.flat, self.flat_at, self.flat_n = np.zeros(0, "<u4"), none, none

    def find(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, n, flat): chunk i has the ids flat[start[i] : start[i] + n[i]]. Chunks are distinct."""
        at = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        size, key = np.diff(at), run_hashes(data[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0])
        place = np.searchsorted(self.keys, key)
        hit = np.flatnonzero(place < len(self.keys))
        hit = hit[self.keys[place[hit]] == key[hit]]
        hit = hit[self.text_n[self.entry[place[hit]]] == size[hit]]
        found = self.entry[place[hit]]
        n = size[hit]
        differ = np.bincount(np.repeat(np.arange(len(hit)), n), data[_ranges(at[hit], n)] != self.text[_ranges(self.text_at[found], n)], len(hit))
        hit, found = hit[differ == 0], found[differ == 0]

        lacks = np.ones(len(chunks), bool)
        lacks[hit] = False
        new = np.flatnonzero(lacks)
        ids = [self.compute(x) for x in chunks.take(pa.array(new)).to_pylist()]
        flat_new, n_new = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        start, count, flat = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), np.concatenate([self.flat, flat_new])
        start[hit], count[hit] = self.flat_at[found], self.flat_n[found]
        start[new], count[new] = len(self.flat) + np.cumsum(n_new) - n_new, n_new

        if len(self.keys) + len(new) > TABLE_CHUNKS:
            self.clear()
        kept = size[new] <= TABLE_BYTES
        ids_at = start[new][kept]
        new, n_new = new[kept], n_new[kept]
        order = np.argsort(key[new], kind="stable")
        where = np.searchsorted(self.keys, key[new][order])
        self.keys = np.insert(self.keys, where, key[new][order])
        self.entry = np.insert(self.entry, where, (len(self.text_n) + order).astype(np.int32))
        add = lambda old, more: np.concatenate([old, more.astype(old.dtype)])
        self.text_at, self.flat_at = add(self.text_at, len(self.text) + np.cumsum(size[new]) - size[new]), add(self.flat_at, len(self.flat) + np.cumsum(n_new) - n_new)
        self.text, self.flat = add(self.text, data[_ranges(at[new], size[new])]), add(self.flat, flat[_ranges(ids_at, n_new)])
        self.text_n, self.flat_n = add(self.text_n, size[new]), add(self.flat_n, n_new)
        return start, count, flat


class Encoder:
    """Ids of texts as the library's encode gives them without adding special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        kind = json.loads(self.tok.to_str())
        pre, norm = kind["pre_tokenizer"] or {}, [x["type"] for x in (kind["normalizer"] or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        #: How added tokens begin; the library finds these in a text before all else.
        self.marks = sorted({t["content"][:2] for t in kind["added_tokens"]})
        self.lower = norm == ["NFC", "Replace", "Lowercase"]
        if any(t["lstrip"] or t["single_word"] or t["content"][:2].isalnum() for t in kind["added_tokens"]):
            self.pattern = None
        elif pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and kind["normalizer"] is None:
            self.pattern = regex.compile(_BYTE_LEVEL)
        elif self.lower and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["invert"] and parts[0]["behavior"] == "Removed":
            self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        else:
            self.pattern = None
        self.letters = byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.pieces: dict[str, bytes] = {}
        self.table = _Table(self._chunk)

    def _piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            out = b"".join([self.four[t.id] for t in self.tok.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            if len(out) <= TABLE_BYTES:
                self.pieces[piece] = out
        return out

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) > LAST_PLAIN:
            return self._library(chunk)
        if self.lower:
            chunk = chunk.lower()
        if chunk.isalpha() or not self.lower and chunk[:1] == " " and chunk[1:].isalpha():
            return self._piece(chunk)
        return b"".join(map(self._piece, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all(pa.array([text], pa.string()))).tobytes()

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null is empty."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
            yield from self._slice(pc.fill_null(texts.slice(lo, hi - lo), ""))
            lo = hi

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = pa.scalar(True) if self.pattern is None else pc.match_substring_regex(texts, _GAP)
        for mark in self.marks:
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        whole = np.full(len(texts), True) if self.pattern is None else whole.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        offsets = split.offsets.to_numpy()
        words = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        number, distinct = words.indices.to_numpy().copy(), words.dictionary
        start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        if not self.lower:  # else a space before a chunk makes no difference
            first, heads = np.unique(number[start], return_inverse=True)
            number[start] = len(distinct) + heads  # the first chunk of a text has no space before it
            distinct = pa.concat_arrays([pc.binary_join_element_wise("", distinct, " "), distinct.take(pa.array(first))])
        begin, n, flat = self.table.find(distinct)
        count = n[number]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = flat[_ranges(begin[number], count)]
        for i, (a, b) in enumerate(zip(upto[start].tolist(), upto[end].tolist(), strict=True)):
            if not whole[i]:
                yield ids[a:b]
                continue
            text = texts[i].as_py()
            plain = self.pattern is not None and not any(m in text for m in self.marks)
            yield np.frombuffer(self._chunk(text) if plain else self._library(text), "<u4")


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
