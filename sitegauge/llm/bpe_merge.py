"""Byte-pair merging of many short words at once, on contiguous arrays of part ids and adjacent ranks."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import regex

#: Fixed values of the byte-level vocabulary: how text is cut before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer words are merged one by one with a heap, as scanning for the minimum is quadratic.
SHORT = 64
#: Entries that a task's cache of encoded words may hold before it is emptied.
CACHE = 120_000
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, inverted."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and token bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        if size > 65536:
            raise ValueError("vocabularies of more than 65536 ids need wider pair keys")
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.special_pattern = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.byte_id = np.zeros(256, dtype=np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int32)
        self.made = made  # by rank
        self.by_pair = {int(k): int(r) for k, r in zip(self.pair_keys, self.pair_rank)}
        # Adjacent ranks of any two single bytes, so that a word's first ranks need no search.
        both = (self.byte_id.astype(np.int64)[:, None] << 16) | self.byte_id[None, :]
        self.byte_pair_rank = self.ranks(both.reshape(-1)).reshape(256, 256)
        lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.token_len, self.token_start = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32) of words of one to SHORT bytes.

        Each row holds a word's part ids and the rank of each part with its right neighbour. A round
        takes the leftmost lowest rank of every row, replaces the pair, closes the gap in the row, and
        refreshes the two ranks next to the merged part. Rows without a mergeable pair leave.
        """
        n = len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        width = int(size.max())
        grid = np.zeros((n, width + 1), dtype=np.uint8)
        grid[np.arange(width + 1) < size[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.byte_id[grid]
        rank = np.full((n, width + 1), NONE, dtype=np.int32)
        rank[:, :width] = self.byte_pair_rank[grid[:, :-1], grid[:, 1:]]
        rank[np.arange(width + 1) >= size[:, None] - 1] = NONE
        final, count = np.zeros((n, width), dtype=np.int32), size.copy()
        live = np.arange(n)
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            low = rank[row, at]
            done = low == NONE
            if done.any():
                final[live[done], : ids.shape[1] - 1] = ids[done, :-1]
                go = ~done
                live, ids, rank, at, low = live[go], ids[go], rank[go], at[go], low[go]
                if not len(live):
                    break
                row = np.arange(len(live))
                most = int(count[live].max())
                ids, rank = ids[:, : most + 1], rank[:, : most + 1]
            # Delete the boundary right of `at`: what lies beyond moves one place left.
            beyond = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(beyond, ids[:, 1:], ids[:, :-1])
            beyond = np.arange(ids.shape[1] - 1) >= at[:, None]
            rank[:, :-1] = np.where(beyond, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            ids[row, at] = self.made[low]
            count[live] -= 1
            left = np.maximum(at - 1, 0)
            fresh = self.ranks(ids[row, left].astype(np.int64) << 16 | ids[row, at])
            rank[row, left] = np.where(at > 0, fresh, rank[row, left])
            fresh = self.ranks(ids[row, at].astype(np.int64) << 16 | ids[row, np.minimum(at + 1, ids.shape[1] - 1)])
            rank[row, at] = np.where(at + 1 < count[live], fresh, NONE)
        raw = final.astype("<u4").tobytes()
        step = width * 4
        return [raw[i * step : i * step + c * 4] for i, c in enumerate(count.tolist())]

    def merge_long(self, word: bytes) -> bytes:
        """The same for one long word, with a heap of (rank, place) over a linked list of parts."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.by_pair.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = int(self.made[r]), False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := get(ids[i] << 16 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (s := get(ids[h] << 16 | ids[i])) is not None:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return np.array([x for x, ok in zip(ids, alive) if ok], dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes whole texts; words that it has merged before come from a bounded cache."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.pieces = regex.compile(PIECES)
        self.starts = regex.compile(r" (?=\S)")
        self.words: dict[str, bytes] = {}  # pieces, merged
        self.units: dict[str, bytes] = {}  # what ``cut`` gives, encoded

    def merge(self, words: set[str]) -> None:
        short: list[tuple[str, bytes]] = []
        for w in words:
            raw = w.encode()
            if len(raw) <= SHORT:
                short.append((w, raw))
            else:
                self.words[w] = self.vocab.merge_long(raw)
        short.sort(key=lambda x: len(x[1]))  # rows of one block are then of like width
        for i in range(0, len(short), 16384):
            block = short[i : i + 16384]
            self.words.update(zip((w for w, _ in block), self.vocab.merge_short([raw for _, raw in block])))

    def segments(self, text: str) -> list[str | int]:
        """The text cut at special tokens, which are whole ids."""
        if self.vocab.special_pattern is None or not any(x in text for x in self.vocab.special):
            return [text]
        out: list[str | int] = []
        end = 0
        for m in self.vocab.special_pattern.finditer(text):
            out += [text[end : m.start()], self.vocab.special[m.group()]]
            end = m.end()
        return [*out, text[end:]]

    def cut(self, text: str) -> list[str]:
        """Units that can be encoded apart: a space before what is no white space always begins a piece.

        Other spaces may go on with a piece of white space, so each run of it stays in one unit but for such a last space.
        """
        first, *rest = self.starts.split(text)
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        if len(self.words) + len(self.units) > CACHE:
            self.words, self.units = {}, {}
        cuts = [[self.cut(s) if isinstance(s, str) else s for s in self.segments(t)] for t in batch]
        units, pieces = set(), set()
        for parts in cuts:
            for part in parts:
                if not isinstance(part, int):
                    units.update(part)
        units.difference_update(self.units)
        split = {u: self.pieces.findall(u) for u in units}
        for found in split.values():
            pieces.update(found)
        pieces.difference_update(self.words)
        self.merge(pieces)
        word = self.words.__getitem__
        for u, found in split.items():
            self.units[u] = word(found[0]) if len(found) == 1 else b"".join(map(word, found))
        unit = self.units.__getitem__
        return [
            b"".join(
                part.to_bytes(4, "little") if isinstance(part, int) else b"".join(map(unit, part))
                for part in parts
            )
            for parts in cuts
        ]

    def encode_bounded(self, batch: list[str], chars: int = 1_000_000) -> list[bytes]:
        """``encode`` in runs of about ``chars`` characters, so that a batch of long texts needs no more memory."""
        out: list[bytes] = []
        run: list[str] = []
        size = 0
        for t in batch:
            run.append(t)
            size += len(t)
            if size >= chars:
                out += self.encode(run)
                run, size = [], 0
        return out + self.encode(run)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The token bytes of ids in a row, gathered from the flat table of all tokens."""
        lengths = self.vocab.token_len[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.vocab.token_start[ids] - (ends - lengths), lengths)
        return self.vocab.flat[shift + np.arange(total)].tobytes()
