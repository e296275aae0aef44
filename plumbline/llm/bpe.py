"""Byte-level BPE by speculation: greedy longest matches are proposed for all unknown words of a block,
one vectorised pass tests every adjacent pair, and only words with a failing pair are merged exactly.

Texts are cut into words a block of bytes at a time, by character classes. The block's different words are looked up
once each, and the ids of all its words are gathered in one step.

The vocabulary file is a parameter (the JSON form of the public tokenizers library); it is never copied.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, blocks, spread

#: Bytes of text that are cut into words at a time.
ENCODE_BYTES = 2 << 20
#: Classes of characters in the public byte-level pattern: letters, numbers, whitespace and all others.
LETTER, NUMBER, SPACE, OTHER = range(4)
#: What the pattern parts from a word after an apostrophe, by its first letter.
SHORT_ENDINGS, LONG_ENDINGS = b"stmd", (b"re", b"ve", b"ll")
NEVER = np.int64(1) << 40


def printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def character_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    all_of_them = "".join(map(chr, range(0x110000)))
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(name, all_of_them):
            out[m.start() : m.end()] = kind
    return out


class Table:
    """Values of 64-bit keys by open addressing, for many keys at once; -1 for keys that aren't in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        keys, slot = keys.astype(np.uint64), self._slot(keys.astype(np.uint64))
        todo = np.arange(len(keys))
        while todo.size:
            free = todo[self.values[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = slot[todo] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while other.size:
            slot[other] = slot[other] + 1 & self.mask
            out[other] = self.values[slot[other]]
            other = other[(self.keys[slot[other]] != keys[other]) & (out[other] >= 0)]
        return out


class ByteBPE:
    """Encoder and decoder. The cache of words is emptied before a block that finds over `cache_entries` in it."""

    def __init__(self, path: str, cache_entries: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        alphabet = printable_bytes()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.id_of = vocab
        self.bytes_of = [b""] * self.size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.longest = max(map(len, vocab))
        self.formed = np.full(self.size, -1, np.int64)  # rank of the merge that makes a token
        self.head = np.arange(self.size)
        self.tail = np.arange(self.size)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = (bytes(alphabet[c] for c in x) for x in (a, b))
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = (rank, whole)
            keys.append(left << 32 | right)
            ranks.append(rank)
            if self.formed[whole] < 0:
                self.formed[whole], self.head[whole], self.tail[whole] = rank, left, right
        self.pairs = Table(np.array(keys, np.int64), np.array(ranks, np.int64))
        self.made = np.array([self.merge[int(k) >> 32, int(k) & 0xFFFFFFFF][1] for k in keys], np.int64)
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        self.short = {}
        for n in range(1, 9):
            some = [(int.from_bytes(b, "big"), i) for b, i in vocab.items() if len(b) == n]
            self.short[n] = Table(np.array([k for k, _ in some], np.uint64), np.array([i for _, i in some], np.int64))
        heads = np.unique(np.array([int.from_bytes(b[:8], "big") for b in vocab if len(b) > 8], np.uint64))
        self.long_heads = Table(heads, np.zeros(len(heads), np.int64))
        self.sound = self._sound()
        self.special_at = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.classes = character_classes()
        sizes = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self.shown, self.shown_size = np.frombuffer(b"".join(self.bytes_of), np.uint8), sizes.astype(np.int32)
        self.shown_at = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.limit = cache_entries
        self._forget()

    def _forget(self) -> None:
        """Empties the cache: the number of each word, and where its ids are in the pool."""
        self.number = {t.encode(): k for k, t in enumerate(self.special)}
        self.pool = np.array([*self.special.values()], np.int32)
        self.pool_at = np.arange(len(self.special), dtype=np.int64)
        self.pool_size = np.ones(len(self.special), np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.pairs.get((left.astype(np.int64) << 32 | right).astype(np.uint64)).astype(np.int64)
        rank[rank < 0] = NEVER
        return rank

    def seams_hold(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: would merging their joined bytes leave the border between them?

        Merges are undone from the last backwards. A merge across the border happens if it comes before the merge
        that takes in its left symbol, and not after the one that takes in its right symbol (equal merges go from
        left to right). `until`: rank of a merge that joins the two tokens in any case.
        """
        holds = np.ones(len(left), bool)
        live = np.arange(len(left))
        a, b = left.astype(np.int64), right.astype(np.int64)
        a_ends = np.full(len(a), NEVER) if until is None else until.astype(np.int64)
        b_ends = a_ends.copy()
        while live.size:
            rank = self._ranks(a, b)
            broken = (rank < a_ends) & (rank <= b_ends) & (rank < NEVER)
            holds[live[broken]] = False
            fa, fb = self.formed[a], self.formed[b]
            undo_a = fa > fb
            a_ends, b_ends = np.where(undo_a, fa, a_ends), np.where(undo_a, b_ends, fb)
            a, b = np.where(undo_a, self.tail[a], a), np.where(undo_a, b, self.head[b])
            go = ~broken & ((fa >= 0) | (fb >= 0))
            live, a, b, a_ends, b_ends = live[go], a[go], b[go], a_ends[go], b_ends[go]
        return holds

    def _sound(self) -> np.ndarray:
        """Which tokens merging makes of their own bytes."""
        made = np.nonzero(self.formed >= 0)[0]
        ok = np.ones(self.size, bool)
        ok[made] = self.seams_hold(self.head[made], self.tail[made], self.formed[made])
        for t in made[np.argsort(self.formed[made])]:
            ok[t] &= ok[self.head[t]] and ok[self.tail[t]]
        return ok

    def greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from each start on, for all words of a block step by step: tokens and the words they are in."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        n = len(data)
        ahead = np.zeros(n, np.uint64)
        for k in range(8):
            ahead |= padded[k : k + n] << np.uint64(8 * (7 - k))
        live, at, ids, words, order = np.arange(len(starts)), starts.copy(), [], [], []
        while live.size:
            left, here = ends[live] - at, ahead[at]
            token, step = np.full(len(live), -1, np.int64), np.zeros(len(live), np.int64)
            long = np.flatnonzero(left > 8)
            for i in long[self.long_heads.get(here[long]) >= 0].tolist():
                word = data[at[i] : at[i] + min(left[i], self.longest)].tobytes()
                for j in range(len(word), 8, -1):
                    if (t := self.id_of.get(word[:j])) is not None:
                        token[i], step[i] = t, j
                        break
            for size in range(8, 0, -1):
                open_ = np.nonzero((token < 0) & (left >= size))[0]
                if open_.size:
                    found = self.short[size].get(here[open_] >> np.uint64(8 * (8 - size)))
                    token[open_] = found
                    step[open_[found >= 0]] = size
            ids.append(token)
            words.append(live)
            order.append(at)
            at = at + step
            go = at < ends[live]
            live, at = live[go], at[go]
        by = np.argsort(np.concatenate(order), kind="stable")
        return np.concatenate(ids)[by], np.concatenate(words)[by]

    def exact_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words at once, the leftmost best pair of every word in each step."""
        sizes = ends - starts
        word = np.repeat(np.arange(len(starts)), sizes)
        symbol = self.byte_ids[data[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]]
        done_symbol, done_word = [], []

        def ranks(i: np.ndarray) -> np.ndarray:
            return np.where(word[i] == word[i + 1], self._ranks(symbol[i], symbol[i + 1]), NEVER)

        rank = np.append(ranks(np.arange(len(word) - 1)), NEVER)
        while True:
            first = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1])
            best = np.minimum.reduceat(rank, first)
            per = np.repeat(best, np.diff(np.append(first, len(word))))
            over = per == NEVER
            done_symbol.append(symbol[over])
            done_word.append(word[over])
            word, symbol, rank, per = word[~over], symbol[~over], rank[~over], per[~over]
            if not word.size:
                break
            i = np.nonzero(rank == per)[0]
            i = i[np.concatenate([[True], word[i[1:]] != word[i[:-1]]])]
            symbol[i] = self.made[rank[i]]
            keep = np.ones(len(word), bool)
            keep[i + 1] = False
            i = i - np.arange(len(i))  # where they stand afterwards: one symbol goes for each
            word, symbol, rank = word[keep], symbol[keep], rank[keep]
            last = i == len(word) - 1
            rank[i[last]] = NEVER
            rank[i[~last]] = ranks(i[~last])
            prior = i[i > 0] - 1
            rank[prior] = ranks(prior)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        return symbol[by], word[by]

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank with a heap and linked neighbours: n log n also for a word of megabytes."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merge.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (m := self.merge.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
        starts = ends - sizes
        flat, word_of = self.greedy(data, starts, ends)
        fails = np.zeros(len(words), bool)
        fails[word_of[~self.sound[flat]]] = True
        inner = np.nonzero(word_of[1:] == word_of[:-1])[0]
        inner = inner[~fails[word_of[inner]]]
        fails[word_of[inner[~self.seams_hold(flat[inner], flat[inner + 1])]]] = True
        held = ~fails[word_of]
        ids, owner = [flat[held]], [word_of[held]]
        short = np.nonzero(fails & (sizes <= 64))[0]
        if short.size:
            merged, which = self.exact_all(data, starts[short], ends[short])
            ids.append(merged)
            owner.append(short[which])
        for i in np.nonzero(fails & (sizes > 64))[0].tolist():
            ids.append(np.array(self.exact(words[i]), np.int64))
            owner.append(np.full(len(ids[-1]), i))
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def word_starts(self, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which bytes begin a word, by the public byte-level pattern, in rows of valid UTF-8 that begin at `edges`.

        Runs of letters, of numbers and of other characters are words, with one blank that precedes them. The last
        whitespace before a word is apart from whitespace further left. An apostrophe that no other sign or blank
        precedes takes a short ending from the letters that follow.
        """
        n = len(x)
        kind = self.classes[:256][x]
        lead = np.flatnonzero(x >= 0xC0)
        if lead.size:
            first, y = x[lead].astype(np.int32), np.concatenate([x, np.zeros(3, np.uint8)])
            more = [(y[lead + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
            two = (first & 0x1F) << 6 | more[0]
            three = (first & 0x0F) << 12 | more[0] << 6 | more[1]
            four = (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
            wide = self.classes[np.where(first < 0xE0, two, np.where(first < 0xF0, three, np.minimum(four, 0x10FFFF)))]
            kind[lead] = wide
            for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
                some = first >= least
                kind[lead[some] + k] = wide[some]
        edge = np.zeros(n, bool)
        edge[edges[edges < n]] = True
        special = self._specials(x, edges)
        for a, b in special:
            edge[a] = True
            if b < n:
                edge[b] = True
        starts = edge.copy()
        starts[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero(starts[1:] & (kind[:-1] == SPACE) & ~edge[1:]) + 1  # words that follow whitespace
        last = after - 1
        while (wide := np.flatnonzero(x[last] & 0xC0 == 0x80)).size:
            last[wide] -= 1
        starts[last] = True
        starts[after] = x[after - 1] != 32
        mark = np.flatnonzero((x == 39) & starts)
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == LETTER) & ~edge[mark + 1]]
        if mark.size:
            y = np.concatenate([x, np.zeros(1, np.uint8)])
            one, two = y[mark + 1], np.where(np.append(edge, True)[mark + 2], 0, y[mark + 2])
            size = np.where(np.isin(one, np.frombuffer(SHORT_ENDINGS, np.uint8)), 2, 0)
            for pair in LONG_ENDINGS:
                size[(one == pair[0]) & (two == pair[1])] = 3
            mark, size = mark[size > 0], size[size > 0]
            starts[mark + 1] = False
            end = mark + size
            starts[end[end < n]] = True
        for a, b in special:
            starts[a:b] = False
            starts[a] = True
        return starts

    def _specials(self, x: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens are, leftmost and longest first within each row."""
        if self.special_at is None:
            return []
        raw = x.tobytes()
        met = [m.span() for m in self.special_at.finditer(raw)] if any(t.encode() in raw for t in self.special) else []
        if not met:
            return []
        cut = np.append(edges, len(raw))
        # a match over the border of two rows hides others, so the rows that a match begins or ends in are searched alone
        rows = np.unique(np.searchsorted(cut, [p for a, b in met for p in (a, b - 1)], "right") - 1)
        return [m.span() for r in rows.tolist() for m in self.special_at.finditer(raw, int(cut[r]), int(cut[r + 1]))]

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The cache's number of each of a block's different words; unknown words are encoded together."""
        known = self.number
        out = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        if new.size:
            fresh = [words[i] for i in new.tolist()]
            ids, sizes = self.encode_words(fresh)
            out[new] = np.arange(len(self.pool_at), len(self.pool_at) + len(new))
            self.pool_at = np.concatenate([self.pool_at, len(self.pool) + np.cumsum(sizes) - sizes])
            self.pool_size = np.concatenate([self.pool_size, sizes])
            self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
            known.update((w, k) for w, k in zip(fresh, out[new].tolist(), strict=True) if len(w) <= 64)
        return out

    def encode_rows(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, end to end, and where each row's ids begin (one more than rows). Bytes that aren't UTF-8
        count as replacement characters."""
        x, at = data[at[0] : at[-1]], at - at[0]
        if not len(x):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        if not _valid(at, x):
            rows = [str(x[a:b].data, "utf-8", "replace").encode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            x, at = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        if len(self.number) > self.limit or len(self.pool) > 8 * self.limit:
            self._forget()
        begin = np.flatnonzero(self.word_starts(x, at[:-1]))
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(x)).astype(np.int64)), pa.py_buffer(x)]).dictionary_encode()
        cut, letters = as_bytes(words.dictionary)
        letters, cut = letters[cut[0] : cut[-1]].tobytes(), (cut - cut[0]).tolist()
        number = self._numbers([letters[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
        which = words.indices.to_numpy()
        sizes = self.pool_size[number][which]
        ids = self.pool[spread(self.pool_at[number][which], sizes)].astype(np.uint32)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begin, at)]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows = [t.encode() for t in texts]
        ids, at = self.encode_rows(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64), np.frombuffer(b"".join(rows), np.uint8))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode_rows(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The text of each row of ids in UTF-8; bytes that aren't become replacement characters."""
        sizes = self.shown_size[ids]
        x = self.shown[spread(self.shown_at[ids], sizes)]
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[at]
        sound, raw = _valid(at, x), x.tobytes()
        rows = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return rows if sound else [r.decode("utf-8", "replace").encode() for r in rows]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def _valid(at: np.ndarray, x: np.ndarray) -> bool:
    """Are all rows UTF-8?"""
    if not len(x) or x.max() < 0x80:
        return True
    begin = at[:-1][at[:-1] < len(x)]
    try:
        return not (x[begin] & 0xC0 == 0x80).any() and str(x.data, "utf-8") is not None
    except UnicodeDecodeError:
        return False


def _check(spec: dict) -> None:
    """Refuses files whose options this encoder doesn't have."""
    model, words = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("a byte-level BPE file without normaliser or prefix blank is needed")
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        raise ValueError("only plain merges are supported")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that strip, normalise or ask for whole words aren't supported")


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """The encoder of a file, made once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encoded_blocks(batch: pa.RecordBatch, column: str, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ids (unsigned 32-bit) and where each row's ids begin, of each block of rows."""
    bpe = tokenizer(path)
    at, data = as_bytes(batch.column(column))
    for i, j in blocks(at, ENCODE_BYTES):
        yield i, *bpe.encode_rows(at[i : j + 1], data)


def packed(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of ids as binary values, in the ids' own width."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * ids.itemsize).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit). A null text has no ids. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids, at in encoded_blocks(batch, "t", path):
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(i, len(at) - 1), packed(ids.astype("<u4"), at)], ["d", "ids"])

    out = docs.select(F.col(id_column).cast("long").alias("d"), F.col(text_column).cast("string").cast("binary").alias("t")).mapInArrow(run, "d long, ids binary")
    return out.select(F.col("d").alias(id_column), "ids")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text): the text of packed ids; bytes that aren't UTF-8 become replacement characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            at, data = as_bytes(batch.column("ids"))
            for i, j in blocks(at, ENCODE_BYTES):
                texts = bpe.decode_rows(np.frombuffer(data[at[i] : at[j]].tobytes(), "<u4"), (at[i : j + 1] - at[i]) // 4)
                texts = [t if ok else None for t, ok in zip(texts, batch.column("ids").slice(i, j - i).is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(i, j - i), pa.array(texts, pa.binary()).cast(pa.string())], ["d", "text"])

    out = encoded.select(F.col(id_column).cast("long").alias("d"), "ids").mapInArrow(run, "d long, text string")
    return out.select(F.col("d").alias(id_column), "text")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of every text's ids and of the text decoded from them, in one pass without a shuffle.

    Null and empty texts have no tokens. Bytes that aren't UTF-8 count as replacement characters. Repeated rows give
    repeated results; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for i, ids, at in encoded_blocks(batch, "t", path):
                texts, raw = bpe.decode_rows(ids, at), memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, len(texts)),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
