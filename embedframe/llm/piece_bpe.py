"""SentencePiece BPE by vectorised merge rounds over flat symbol arrays.

The words of many texts lie one after another in flat numpy arrays: symbol, word, and the rank of the
pair that a symbol forms with the next one of its word.  A round takes each word's minimum rank (a
segmented minimum), merges that pair at all its leftmost occurrences that don't overlap, closes the
gaps, and looks up only the pairs that the merges made.  Words without a pair leave; rounds go on
until no pair remains.

Merging one pair at a time, leftmost first, may make a better pair which then comes before the other
occurrences.  A round sees that: the occurrences of a word are merged up to the first one whose new
pairs rank as good as the minimum or better, and the rest wait for the next round.  So the result is
that of the one-by-one order for any vocabulary.

A word is a run of spaces with what follows up to the next space; no piece has a space after another
character, which is checked when the model is loaded.  A long word is cut where no piece holds the two
neighbouring characters.  Runs of spaces form pieces of one common rank, worse than all others, which
leftmost merging builds from left to right: pieces of the greatest length and a rest.  Where the
vocabulary has that form (checked, too), such runs are cut in one step instead of one merge a round.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

SPACE = "▁"
NO_PAIR = np.iinfo(np.int64).max
LONG_WORD = 48
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("piece_bytes", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """Vocabulary, merge table and word cache of a model file."""

    def __init__(self, path: str, most_words: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation, a dummy prefix and escaped spaces are supported")
        if train.treat_whitespace_as_suffix or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("suffix spaces, user-defined and unused pieces are not supported")
        self.n = len(model.pieces)
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == train.eos_piece)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(SPACE in s[1:] and s.strip(SPACE) and SPACE in s.lstrip(SPACE) for s in normal):
            raise ValueError("a piece has a space after another character")
        self.byte_id = [0] * 256
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                b = int(p.piece[1:-1], 16)
                self.byte_id[b] = i
                self.bytes_of.append(bytes([b]))
            elif p.type == UNKNOWN:
                self.bytes_of.append(train.unk_surface.encode())
            else:
                self.bytes_of.append(b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode())
        self.byte_ids = set(self.byte_id)
        # a symbol is a piece's id, or n + code point for a character without a piece
        self.char_symbol = np.arange(self.n, self.n + 0x110000, dtype=np.int64)
        for s, i in normal.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        order = {v: r for r, v in enumerate(sorted({-model.pieces[i].score for i in normal.values()}))}
        symbol = lambda s: normal[s] if s in normal else self.n + ord(s) if len(s) == 1 else None
        pairs = {}
        for s, i in normal.items():
            for cut in range(1, len(s)):
                a, b = symbol(s[:cut]), symbol(s[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[-model.pieces[i].score], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.bigrams = np.array(sorted({ord(x) << 32 | ord(y) for s in normal for x, y in zip(s, s[1:])}), dtype=np.int64)
        # runs of spaces: the pieces of the worst rank are runs, and no other piece has two spaces
        runs = {len(s): i for s, i in normal.items() if not s.strip(SPACE)}
        worst = {s for s, i in normal.items() if order[-model.pieces[i].score] == len(order) - 1}
        self.run_rank = -1
        if len(runs) > 1 and worst | {SPACE} == {SPACE * k for k in runs} and not any(SPACE * 2 in s for s in normal if s.strip(SPACE)):
            rests = [_run_pieces(k, runs) for k in range(max(runs) + 1)]
            if rests[-1] == [max(runs)]:  # then a longer run starts with that piece, and the rest goes on alone
                self.run_rank = len(order) - 1
                self.run_ids = np.array([runs.get(k, 0) for k in range(max(runs) + 1)])
                self.run_sizes = np.zeros((len(rests), max(runs)), np.int64)  # by rest and offset: size of the piece that starts there
                for k, sizes in enumerate(rests):
                    self.run_sizes[k, np.cumsum([0, *sizes])[:-1]] = sizes
        alone = [c for c in "\n\t\r" if not any(c in s for s in normal if len(s) > 1)]
        inside = re.escape("".join(alone))
        self.split = re.compile(f"{SPACE}*[^{SPACE}{inside}]+|{SPACE}+" + (f"|[{inside}]" if alone else "")).findall
        self.most_words = most_words
        self.id_text = [str(i) for i in range(self.n)]
        self.words: dict[str, tuple[str, bytes]] = {}  # ids as decimal text and as little-endian integers
        self.old: dict[str, tuple[str, bytes]] = {}

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) that symbols ``a`` and ``b`` make side by side."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], NO_PAIR), self.made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and where each word's begin (and the last end), by rounds over all of them."""
        cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lens)
        sym = self.char_symbol[cps]
        # segments: words, and parts of long words between characters that no piece holds side by side
        new = np.r_[True, word[1:] != word[:-1]][:len(sym)]
        inner = np.flatnonzero(~new & (lens[word] > LONG_WORD))
        key = cps[inner - 1] << 32 | cps[inner]
        at = np.minimum(np.searchsorted(self.bigrams, key), len(self.bigrams) - 1)
        new[inner[self.bigrams[at] != key]] = True
        seg = np.cumsum(new) - 1
        home = np.arange(len(sym))  # place of a symbol's first character: where it goes back to
        done_at, done_sym = [], []
        rank, made = self._ranks(sym, seg)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = low == NO_PAIR
            if over.any():
                done_at.append(home[over])
                done_sym.append(sym[over])
                stay = ~over
                sym, seg, home, rank, made, low = sym[stay], seg[stay], home[stay], rank[stay], made[stay], low[stay]
                if not len(sym):
                    break
            runs = low == self.run_rank
            if runs.any():
                at, pieces = self._cut_runs(sym[runs], seg[runs], home[runs])
                done_at.append(at)
                done_sym.append(pieces)
                stay = ~runs
                sym, seg, home, rank, made, low = sym[stay], seg[stay], home[stay], rank[stay], made[stay], low[stay]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            at = at[_every_other(at)]
            at = self._up_to_first_better(at, sym, seg, made, low)
            sym[at] = made[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            stay = ~gone
            # a merge's left neighbour may itself be gone: then the one before it is the neighbour
            touched[np.maximum(at - 2, 0)] |= gone[np.maximum(at - 1, 0)]
            sym, seg, home, rank, made, touched = sym[stay], seg[stay], home[stay], rank[stay], made[stay], touched[stay]
            t = np.flatnonzero(touched)
            rank[t], made[t] = self._ranks(sym, seg, t)
        out_at, out = np.concatenate([np.zeros(0, np.int64), *done_at]), np.concatenate([np.zeros(0, np.int64), *done_sym])
        order = np.argsort(out_at, kind="stable")
        owner, out = word[out_at[order]], out[order]
        strange = np.flatnonzero(out >= self.n)  # characters without a piece are spelled in bytes
        if len(strange):
            spelled = [[self.byte_id[b] for b in chr(s - self.n).encode("utf-8", "surrogatepass")] for s in out[strange].tolist()]
            size = np.ones(len(out), np.int64)
            size[strange] = [len(x) for x in spelled]
            out, owner = np.repeat(out, size), np.repeat(owner, size)
            out[out >= self.n] = np.concatenate(spelled)
        return out, np.searchsorted(owner, np.arange(len(words) + 1))

    def _ranks(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(sym)) if at is None else at
        rank, made = np.full(len(at), NO_PAIR), np.zeros(len(at), np.int64)
        inside = np.flatnonzero(at + 1 < len(sym))
        inside = inside[seg[at[inside]] == seg[at[inside] + 1]]
        rank[inside], made[inside] = self._pair(sym[at[inside]], sym[at[inside] + 1])
        return rank, made

    def _up_to_first_better(self, at: np.ndarray, sym: np.ndarray, seg: np.ndarray, made: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The merges ``at`` of each segment up to the first that makes a pair as good as its own or better."""
        piece, best = made[at], low[at]
        last = len(sym) - 1
        right = np.minimum(at + 2, last)
        better = (at + 2 <= last) & (seg[right] == seg[at]) & (self._pair(piece, sym[right])[0] <= best)
        left = np.maximum(at - 1, 0)
        before = sym[left].copy()
        joined = np.r_[False, at[1:] - at[:-1] == 2]  # the merge before it stands right beside it
        before[joined] = piece[np.flatnonzero(joined) - 1]
        better |= (at >= 1) & (seg[left] == seg[at]) & (self._pair(before, piece)[0] <= best)
        if not better.any():
            return at
        s = seg[at]
        first = np.r_[True, s[1:] != s[:-1]]
        earlier = np.cumsum(better) - better  # better ones before this, over all segments
        base = np.repeat(earlier[first], np.diff(np.r_[np.flatnonzero(first), len(at)]))
        return at[earlier == base]

    def _cut_runs(self, sym: np.ndarray, seg: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space, most = self.run_ids[1], len(self.run_ids) - 1
        first = np.flatnonzero(np.r_[True, (sym[1:] != sym[:-1]) | (seg[1:] != seg[:-1])] | (sym != space))
        length = np.diff(np.r_[first, len(sym)])
        offset = np.arange(len(sym)) - np.repeat(first, length)
        rest = np.minimum(most, np.repeat(length, length) - offset // most * most)
        size = np.where(sym == space, self.run_sizes[rest, offset % most], 1)
        keep = size > 0
        return home[keep], np.where(sym == space, self.run_ids[size], sym)[keep]

    def learn(self, texts: Iterable[list[str]]) -> None:
        """Merge the words that the cache lacks, all at once.  The cache keeps the words since it was last
        full, and those of the time before."""
        if len(self.words) > self.most_words:
            self.words, self.old = {}, self.words
        missing = set().union(*texts).difference(self.words)
        kept = [w for w in missing if w in self.old]
        self.words.update(zip(kept, map(self.old.__getitem__, kept)))
        todo = list(missing.difference(kept))
        ids, cuts = self.merge(todo)
        raw, names, cuts = ids.astype("<i4").tobytes(), list(map(self.id_text.__getitem__, ids.tolist())), cuts.tolist()
        self.words.update((w, (" ".join(names[a:b]), raw[4 * a:4 * b])) for w, a, b in zip(todo, cuts[:-1], cuts[1:], strict=True))

    def cut(self, text: str | None) -> list[str]:
        return self.split(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, the end id last."""
        words = self.cut(text)
        self.learn([words])
        return [*np.frombuffer(b"".join([self.words[w][1] for w in words]), "<i4").tolist(), self.end_id]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the space that the first piece starts with goes, bytes that are no UTF-8 become U+FFFD one by one."""
        parts = list(map(self.bytes_of.__getitem__, ids))
        if parts and ids[0] not in self.byte_ids:
            parts[0] = parts[0].removeprefix(b" ")
        return b"".join(parts).decode("utf-8", "piece_bytes")


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of a file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _run_pieces(n: int, sizes: dict[int, int]) -> list[int]:
    """Sizes that leftmost merging makes of a run of ``n`` single spaces."""
    parts = [1] * n
    while (at := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in sizes), None)) is not None:
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _every_other(at: np.ndarray) -> np.ndarray:
    """In each run of consecutive numbers, the first, third, fifth...: leftmost merges don't overlap."""
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1]) if len(at) else np.zeros(0, np.int64)
    offset = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    return offset % 2 == 0


#: Characters of the texts whose new words are merged at once.
CHUNK_CHARS = 2_000_000


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every whole text.

    NULL and empty texts have the end id alone and decode to the empty string; equal rows give equal
    results; other columns are ignored; an empty table gives an empty result.  A text's length is bounded by
    memory only."""
    def compute(texts: list[str | None]) -> list[pa.Array]:
        model = pieces(path)
        n, ids_sha, out_sha, all_ids, decoded = [], [], [], [], []
        end, tail = model.end_id, str(model.end_id)
        at = 0
        while at < len(texts):
            words, chars = [], 0
            while at < len(texts) and (not words or chars < CHUNK_CHARS):
                words.append(model.cut(texts[at]))
                chars += len(texts[at] or "")
                at += 1
            model.learn(words)
            for ws in words:
                found = [model.words[w] for w in ws]
                ids = np.frombuffer(b"".join([v[1] for v in found]), "<i4").tolist()
                text = model.decode(ids)
                n.append(len(ids) + 1)
                ids_sha.append(hashlib.sha256(" ".join([*[v[0] for v in found], tail]).encode()).hexdigest())
                out_sha.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    all_ids.append([*ids, end])
                    decoded.append(text)
        cols = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
        return cols + ([pa.array(all_ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())] if with_ids else [])

    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        added += [("ids", T.ArrayType(T.LongType())), ("decoded", T.StringType())]
    return common.with_columns(docs.select(id_col, text_col), added, text_col, compute, carry=[id_col])
