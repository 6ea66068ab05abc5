"""Tokenizer passes over Arrow batches.

A text is cut at safe boundaries: places where the tokenizer's own splitting pattern always
starts a new piece, so that encoding the parts one by one gives the ids of the whole.  For the
byte-level pattern these are single spaces and single line feeds with a visible character on both
sides (a space belongs to what follows it; a line feed stands alone).  Parts repeat a lot, so each
Arrow batch is dictionary-encoded, each distinct part is encoded once by the library, and ids are
gathered by index.  Batches go to the library balanced by bytes, so one very long text or many
short ones cost the same memory.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import buffers, ranges, slices

#: Bytes of text that are tokenized at once, and bytes of a call of the library.
CHUNK_BYTES = 4 << 20
CALL_BYTES = 256 << 10

#: Visible ASCII: neither white space nor a control character.  Bytes from 0x80 are left out, as
#: some multi-byte characters are white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_loaded: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def safe_cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending byte positions that cut the texts into parts, bounds of texts included."""
    n = len(raw)
    if n < 3:
        return np.unique(offsets)
    seen = _VISIBLE[raw]
    # A non-ASCII letter is common beside a space, so characters that begin with the bytes of
    # Latin letters (U+00C0-024F) count as visible too.
    lead = (raw >= 0xC3) & (raw <= 0xC8)
    trail = np.zeros(n, bool)
    trail[1:] = lead[:-1]
    before, after = seen | trail, seen | lead
    mid = before[:-2] & after[2:]
    space = np.flatnonzero(mid & (raw[1:-1] == 0x20)) + 1
    line = np.flatnonzero(mid & (raw[1:-1] == 0x0A)) + 1
    mark = np.zeros(n + 1, bool)
    mark[space] = True
    mark[line] = True
    mark[line + 1] = True
    mark[offsets] = True
    return np.flatnonzero(mark)


# Fixed value: the public splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves; the other bytes have the signs from U+0100 on.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def splits_alike(config: dict) -> bool:
    """Whether a tokenizer's file splits texts by PATTERN alone, so that safe cuts are safe."""
    pre, model = config.get("pre_tokenizer") or {}, config["model"]
    own = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return bool(own and config.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout"))


def fast_core(config: dict):
    """An encoding of plain text with the same merges, or None if it can't be the same.

    It merges by rank, so it gives the file's ids only if the file's merges come in the order of
    their ids; that is looked up merge by merge.
    """
    try:
        import tiktoken
    except ImportError:
        return None
    model = config["model"]
    if any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    byte = byte_of_sign()
    ranks = {bytes(byte[c] for c in word): k for word, k in vocab.items() if k < 256 + len(pairs)}
    return tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_parts(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Which parts are visible ASCII and Latin letters alone, after one space at most.

    Every version of Unicode splits these alike.
    """
    ok = _VISIBLE[raw]
    lead = (raw >= 0xC3) & (raw <= 0xC8)
    ok |= lead
    ok[1:] |= lead[:-1]
    first = cuts[:-1]
    ok[first] |= raw[first] == 0x20
    wrong = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~ok, out=wrong[1:])
    size = np.diff(cuts)
    return (wrong[cuts[1:]] == wrong[first]) & ((size > 1) | (raw[first] != 0x20))


class Encoder:
    """Whole texts to ids, or to their number alone.

    Plain parts of a batch are encoded in one call of a core with the same merges, with line feeds
    between them, which are tokens of their own there.  All other parts go through the tokenizer's
    own library one by one, and texts that hold an added token (special or not) go through it
    whole, as such a token may take in the white space around it.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.split, self.fast, self.added = False, None, None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            with open(path, encoding="utf-8") as f:
                config = json.load(f)
            self.split = splits_alike(config)
            self.fast = fast_core(config) if self.split else None
            names = sorted({re.escape(x["content"]) for x in config.get("added_tokens") or () if x["content"]})
            self.added = "|".join(names) or None
        elif path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            raise ValueError(f"no tokenizer library is known for {path!r}")
        if self.fast:
            self.line = self.fast.encode_ordinary("\n")[0]

    def _call(self, parts: list[str]) -> list[bytes]:
        if hasattr(self.model, "encode_batch_fast"):
            return [array("I", x.ids).tobytes() for x in self.model.encode_batch_fast(parts, add_special_tokens=False)]
        return [array("I", x).tobytes() for x in self.model.encode(parts, num_threads=1)]

    def _library(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, one after the other, and how many each has."""
        out: list[bytes] = []
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) <= CALL_BYTES):
                size += len(parts[j])
                j += 1
            out += self._call([str(p, "utf-8") for p in parts[i:j]])
            i = j
        return np.frombuffer(b"".join(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def _core(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain parts, given by their places in the bytes."""
        line = np.full(int(size.sum()) + len(size), 0x0A, np.uint8)
        at = np.cumsum(size + 1) - size - 1
        inner = ranges(size)
        line[np.repeat(at, size) + inner] = raw[np.repeat(first, size) + inner]
        ids = self.fast.encode_to_numpy(line.tobytes().decode(), disallowed_special=())
        end = np.flatnonzero(ids == self.line)
        return ids[ids != self.line], np.diff(np.concatenate([[-1], end])) - 1

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, one after the other, and the bounds of each."""
        raw, cuts = buffers(parts.cast(pa.large_binary()).view(pa.large_string()))
        plain = plain_parts(raw, cuts) if self.fast else np.zeros(len(parts), bool)
        size = np.zeros(len(parts), np.int64)
        some, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, counts = self._core(raw, cuts[some], np.diff(cuts)[some]) if len(some) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        more, others = self._library(parts.take(pa.array(rest)).to_pylist())
        size[some], size[rest] = counts, others
        start = np.zeros(len(parts), np.int64)
        start[some] = np.cumsum(counts) - counts
        start[rest] = len(ids) + np.cumsum(others) - others
        return np.concatenate([ids, more]), np.stack([start, size])

    def _parts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cuts, ids of the distinct parts, and each part's start among them and size."""
        cuts = safe_cuts(raw, offsets) if self.split else np.unique(offsets)
        kind, width = (pa.binary(), np.int32) if len(raw) < 1 << 31 else (pa.large_binary(), np.int64)
        parts = pa.Array.from_buffers(kind, len(cuts) - 1, [None, pa.py_buffer(cuts.astype(width)), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = parts.dictionary_encode()
        ids, places = self._distinct(coded.dictionary)
        start, size = places[:, coded.indices.to_numpy()]
        return cuts, ids, start, size

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold an added token and are not to be cut."""
        if not self.split or not self.added:
            return np.zeros(0, np.int64)
        return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, self.added), False).to_numpy(zero_copy_only=False))

    def _apart(self, texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts without those to be kept whole, and those texts' ids and their numbers."""
        ids, counts = self._library(pc.fill_null(texts, "").take(pa.array(whole)).cast(pa.binary()).to_pylist())
        hidden = np.zeros(len(texts), bool)
        hidden[whole] = True
        return pc.if_else(pa.array(hidden), "", pc.fill_null(texts, "")), ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an array, one after the other, and bounds (n + 1 entries)."""
        if len(whole := self._whole(texts)):
            rest, special, counts = self._apart(texts, whole)
            ids, bounds = self.encode(rest)
            every = np.diff(bounds)
            pieces, at = np.split(ids, bounds[whole]), 0
            out = [pieces[0]]
            for piece, n in zip(pieces[1:], counts.tolist(), strict=True):
                out += [special[at : at + n], piece]
                at += n
            every[whole] = counts
            return np.concatenate(out), np.concatenate([[0], np.cumsum(every)])
        raw, offsets = buffers(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cuts, ids, start, size = self._parts(raw, offsets)
        out = ids[np.repeat(start, size) + ranges(size)]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return out, total[np.searchsorted(cuts, offsets)]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; ids themselves are not put together."""
        if len(whole := self._whole(texts)):
            rest, _, counts = self._apart(texts, whole)
            out = self.lengths(rest)
            out[whole] = counts
            return out
        raw, offsets = buffers(texts)
        if not len(raw):
            return np.zeros(len(offsets) - 1, np.int64)
        cuts, _, _, size = self._parts(raw, offsets)
        total = np.zeros(len(cuts), np.int64)
        np.cumsum(size, out=total[1:])
        return np.diff(total[np.searchsorted(cuts, offsets)])


def encoded(path: str, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, ids and bounds of byte-balanced parts of a column."""
    model = encoder(path)
    for i, j in slices(column, CHUNK_BYTES):
        yield i, j, *model.encode(column.slice(i, j - i))
