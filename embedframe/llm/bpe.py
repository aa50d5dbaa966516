"""Byte-level BPE as a lazily determinised finite-state transducer.

Encoding.  A token sequence is the BPE encoding of its bytes exactly when each token encodes
to itself and each adjacent pair does (two tokens whose joint bytes merge differently never
stand side by side).  That makes BPE a finite-state relation: a nondeterministic machine reads
bytes down the vocabulary's trie and, where a token ends and fits the token before it, starts
again at the root.  ``Transducer`` determinises it while it reads: a state is the set of
(trie node, token before it, output not yet emitted), and a step emits the output that all
members agree on, so a token leaves after a lookahead of at most the longest token's length.
States and steps are kept for later texts; when there are ``max_states`` the tables start anew.

Decoding.  ``Utf8Stream`` takes token bytes as they come and gives out only whole code points:
its state is the unfinished sequence at the end.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common


def load_tiktoken(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def load_byte_level_json(path: str) -> dict[bytes, int]:
    """Token bytes to id of a byte-level vocabulary whose ids follow merge order; special tokens
    are left out.  Its characters stand for bytes: printable Latin-1 ones for themselves, the
    others for the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def load_added_tokens(path: str) -> dict[str, int]:
    """Text to id of the added tokens of such a file.  Only tokens that match their exact text
    anywhere are supported, and none may start with another."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    out = {t["content"]: t["id"] for t in added}
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with single_word, lstrip, rstrip or normalized are not supported")
    if any(a != b and a.startswith(b) for a in out for b in out):
        raise ValueError("an added token starts with another one")
    return out


class Transducer:
    """Encodes byte strings (one pre-token each) by ``ranks``; see the module docstring."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000, max_pieces: int = 1_000_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        # trie: node -> {byte: node}; ends[node] = token id or -1
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for b in token:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.pieces = _Pieces(self, max_pieces)
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, b""),)
        self.ids = {start: 0}
        self.sets = [start]
        self.steps: list[dict[int, tuple[int, bytes]]] = [{}]
        self.final = [b""]
        self.fits: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: lowest rank first, leftmost first."""
        rank = self.ranks.get
        none = 1 << 62
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [rank(data[i:i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def _fit(self, before: int, token: int) -> bool:
        key = (before, token)
        if (known := self.fits.get(key)) is None:
            if before < 0:
                known = self.merge(self.bytes_of[token]) == [token]
            else:
                known = self._fit(-1, token) and \
                    self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
            self.fits[key] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, bytes]:
        trie, ends, fits = self.trie, self.ends, self.fits
        members, done = [], None
        for node, before, pending in self.sets[state]:
            child = trie[node].get(byte)
            if child is None:
                continue
            if trie[child]:
                members.append((child, before, pending))
            if done is None and (token := ends[child]) >= 0:
                fit = fits.get((before, token))
                if fit or fit is None and self._fit(before, token):
                    done = (0, token, pending + token.to_bytes(4, "little"))
        if done is None:
            raise AssertionError("no encoding of a prefix")
        members.append(done)
        first = members[0][2]
        agreed = len(first)
        if agreed:
            for _, _, pending in members:
                while pending[:agreed] != first[:agreed]:
                    agreed -= 4
            if agreed:
                members = [(n, t, p[agreed:]) for n, t, p in members]
        target = tuple(members)
        nxt = self.ids.get(target)
        if nxt is None:
            nxt = self.ids[target] = len(self.sets)
            self.sets.append(target)
            self.steps.append({})
            self.final.append(target[-1][2])
        out = self.steps[state][byte] = (nxt, first[:agreed])
        return out

    def encode_bytes(self, data: bytes) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        if (whole := self.ranks.get(data)) is not None:
            return whole.to_bytes(4, "little")
        if len(self.sets) > self.max_states:
            self._reset()
        steps, state, out = self.steps, 0, []
        for byte in data:
            found = steps[state].get(byte)
            if found is None:
                found = self._step(state, byte)
            state, emitted = found
            if emitted:
                out.append(emitted)
        out.append(self.final[state])
        return b"".join(out)

    def encode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))


class _Pieces(dict):
    """Ids of short pre-tokens seen lately; the transducer reads the others."""

    def __init__(self, machine: Transducer, most: int):
        super().__init__()
        self.machine, self.most = machine, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.machine.encode_bytes(piece.encode("utf-8"))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the whole code points that have arrived, ``close``
    what is left.  Invalid bytes pass unchanged, so the output's bytes equal the input's."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        self.held = b""
        for back in range(1, min(3, len(data)) + 1):  # a lead byte whose continuation hasn't come
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                if need > back:
                    data, self.held = data[:-back], data[-back:]
                break
            if b < 0x80:
                break
        return data

    def close(self) -> bytes:
        out, self.held = self.held, b""
        return out


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes], block: int = 4096) -> Iterator[bytes]:
    """Bytes of the tokens, cut only between code points."""
    stream, ids = Utf8Stream(), list(ids)
    get = bytes_of.__getitem__
    for i in range(0, len(ids), block):
        if out := stream.feed(b"".join(map(get, ids[i:i + block]))):
            yield out
    if out := stream.close():
        yield out


_CODECS: dict[tuple[str, str], tuple] = {}


def codec(path: str, pattern: str):
    """(transducer, findall) of a vocabulary file, built once in each Python worker."""
    key = (path, pattern)
    if key not in _CODECS:
        gc.disable()  # its tables are millions of small objects without cycles
        ranks = load_byte_level_json(path) if path.endswith(".json") else load_tiktoken(path)
        _CODECS[key] = (Transducer(ranks), regex.compile(pattern).findall)
    return _CODECS[key]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    Each match of ``pattern`` is encoded by itself.  NULL and empty texts have no ids and the
    digests of the empty string; equal rows give equal results; other columns are ignored; an
    empty table gives an empty result.  A text's length is bounded by memory only: pre-tokens of
    any length take time in proportion to their bytes."""
    def compute(texts: list[str | None]) -> list[pa.Array]:
        machine, findall = codec(path, pattern)
        n, ids_sha, out_sha, all_ids = [], [], [], []
        for text in texts:
            ids = machine.encode_pieces(findall(text)) if text else b""
            out = hashlib.sha256()
            for part in decode_stream(np.frombuffer(ids, "<u4").tolist(), machine.bytes_of):
                out.update(part)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            out_sha.append(out.hexdigest())
            if with_ids:
                all_ids.append(np.frombuffer(ids, "<u4").astype(np.int64))
        cols = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
        return cols + ([pa.array(all_ids, pa.list_(pa.int64()))] if with_ids else [])

    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        added.append(("ids", T.ArrayType(T.LongType())))
    return common.with_columns(docs.select(id_col, text_col), added, text_col, compute, carry=[id_col])
