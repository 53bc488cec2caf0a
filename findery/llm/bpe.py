"""Byte-pair encoding by speculation and verification, and its inverse.

A text is cut at single spaces into chunks whose tokens depend on the chunk alone; known chunks are
answered from a bounded cache.  Unknown words are *speculated*: greedy longest match proposes tokens.
All adjacent pairs of all proposals are then *verified* in one vectorised walk down the merge trees;
a proposal whose pairs are all compatible is the encoding, and only the other words are merged exactly.

Why checking pairs is enough: merges happen in order of rank, so two neighbours stay apart exactly if
no merge across their border comes before the merges that build them up, and that depends on the
right edge of the left token and the left edge of the right one alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.common import small_batches

#: Chunks kept in a worker's cache before it starts afresh: a bound on memory that changes no result.
CACHE_CHUNKS = 200_000
#: Characters up to here are classed alike by every version of Unicode, and are their own normal form.
PLAIN_LIMIT = "ɏ"
#: Ends a word's last symbol where the vocabulary has word ends; the byte never occurs in UTF-8.
WORD_END = b"\xff"
#: Texts whose unknown words are encoded together.
GROUP = 512
#: Longer words (bytes) are proposed one by one; the others together, so many bytes at a time.
LONG, TOGETHER = 256, 1 << 17
#: Stands between words that are proposed together; no token has it.
BORDER = 256
NO_RANK = np.int64(1) << 40
NO_CODE = 1 << 60


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest for U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    table = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in own):
        table[chr(256 + k)] = b
    return table


class PairHash:
    """Merge codes by pair of ids: open addressing in numpy, a few gathers for a whole array of pairs."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, bits: int = 19) -> None:
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._codes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_CODE, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # of the keys that want a free slot one gets it; the others go on to the next slot
            free = left[self._keys[at[left]] < 0]
            self._keys[at[free]] = keys[free]
            self._codes[at[free]] = np.where(self._keys[at[free]] == keys[free], codes[free], NO_CODE)
            placed = self._keys[at[left]] == keys[left]
            self._codes[at[left[placed]]] = codes[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, NO_CODE where there is none."""
        at = self._slot(keys)
        held = self._keys[at]
        out = np.where(held == keys, self._codes[at], NO_CODE)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self._mask
            held = self._keys[at[left]]
            out[left[held == keys[left]]] = self._codes[at[left[held == keys[left]]]]
            left = left[(held != keys[left]) & (held >= 0)]
        return out


class MergeTable:
    """Vocabulary and merges of a tokenizer file, with what both ways of encoding need."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, chars = spec["model"], _byte_of_char()
        suffix = model.get("end_of_word_suffix") or ""
        self.word_end = bool(suffix)

        def raw(token: str) -> bytes:
            end = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if end else token
            return bytes(chars[c] for c in body) + (WORD_END if end else b"")

        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*model["vocab"].values(), *self.specials.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        ids: dict[str, int] = {}
        for token, i in model["vocab"].items():
            ids[token] = i
            self.bytes_of[i] = raw(token)
        for content, i in self.specials.items():
            self.bytes_of[i] = content.encode()
        #: left id * size + right id: rank << 20 | merged id
        self.merges: dict[int, int] = {}
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = ids[a], ids[b], ids[(a[: -len(suffix)] if suffix and a.endswith(suffix) else a) + b]
            if i * self.size + j not in self.merges:
                self.merges[i * self.size + j] = rank << 20 | k
                if self.rank[k] < 0:
                    self.rank[k], self.left[k], self.right[k] = rank, i, j
        self._codes_of = PairHash(np.array(list(self.merges), np.int64), np.array(list(self.merges.values()), np.int64))
        base = [i for i in ids.values() if len(self.bytes_of[i].removesuffix(WORD_END) if suffix else self.bytes_of[i]) == 1]
        self.base = {self.bytes_of[i]: i for i in base}
        self._first = np.full((2, 256), -1, np.int64)
        for b, i in self.base.items():
            self._first[int(len(b) > 1), b[0]] = i
        self._greedy = self._reachable(base)
        lengths: dict[bytes, set[int]] = {}
        for b in self._greedy:
            lengths.setdefault(b[:2], set()).add(len(b))
            lengths.setdefault(b[:1], set()).add(1)
        #: by the first two bytes: how long proposals can be, the longest first
        self._lengths = {
            b: tuple(sorted(n | {1} if b[:1] in self._greedy else n, reverse=True)) for b, n in lengths.items()
        }
        self._grow_trie()

    def _grow_trie(self) -> None:
        """The tokens that may be proposed as a trie in arrays: one and two bytes by table, longer ones by a hash of (node, byte)."""
        nodes: dict[int, int] = {}
        ends: dict[int, int] = {}
        for token, i in self._greedy.items():
            node = 0
            for b in token:
                node = nodes.setdefault(node * (BORDER + 1) + b, len(nodes) + 1)
            ends[node] = i
        self._ends = np.full(len(nodes) + 1, -1, np.int32)
        self._ends[list(ends)] = list(ends.values())
        self._ones, self._twos = np.full(BORDER + 1, -1, np.int32), np.full((BORDER + 1) ** 2, -1, np.int32)
        for a in range(BORDER):
            if one := nodes.get(a):
                self._ones[a] = ends.get(one, -1)
                for b in range(BORDER):
                    self._twos[a * (BORDER + 1) + b] = nodes.get(one * (BORDER + 1) + b, -1)
        self._steps = PairHash(np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int64), max(10, (2 * len(nodes)).bit_length()))

    def _reachable(self, base: list[int]) -> dict[bytes, int]:
        """Tokens that exact merging of their own bytes gives back; only these may be proposed."""
        made = np.flatnonzero(self.rank >= 0)
        sound = self.compatible(self.left[made], self.right[made], self.rank[made])
        ok = np.zeros(self.size, bool)
        ok[base] = True
        for k, s in sorted(zip(made.tolist(), sound.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            ok[k] = s and ok[self.left[k]] and ok[self.right[k]]
        return {self.bytes_of[i]: i for i in np.flatnonzero(ok).tolist()}

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Which pairs stay apart, if nothing happens after rank ``until``.

        Walks back in time: of the two pieces at the border the one made last is undone first.  A merge
        across the border happens if its rank comes before both pieces are used up; of two equal merges
        the left one comes first, so on the right side an equal rank loses.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        gone_a = np.full(len(a), NO_RANK - 1) if until is None else until.astype(np.int64).copy()
        gone_b = gone_a.copy() if until is None else gone_a - 1
        apart, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            cross = self._codes_of(x * self.size + y) >> 20
            joined = (cross < gone_a[live]) & (cross <= gone_b[live])
            apart[live[joined]] = False
            rx, ry = self.rank[x], self.rank[y]
            from_a, more = rx > ry, (rx >= 0) | (ry >= 0)
            sa, sb = live[from_a & more], live[~from_a & more]
            gone_a[sa], gone_b[sb] = self.rank[a[sa]], self.rank[b[sb]]
            a[sa], b[sb] = self.right[a[sa]], self.left[b[sb]]
            live = live[more & ~joined]
        return apart

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merge by rank, the leftmost first, with a heap over a linked list: n log n steps."""
        if self.word_end:
            body = word.removesuffix(WORD_END)
            ids = [self.base[body[i : i + 1]] for i in range(len(body) - 1)] + [self.base[body[-1:] + WORD_END]]
        else:
            ids = [self.base[word[i : i + 1]] for i in range(len(word))]
        n, size, merges = len(ids), self.size, self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := merges.get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            code, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or merges.get(ids[i] * size + ids[j]) != code:
                continue
            ids[i], ids[j] = code & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(ids[i] * size + ids[k]):
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := merges.get(ids[h] * size + ids[i])):
                heapq.heappush(heap, (m, h))
        return [i for i in ids if i >= 0]

    def _propose_long(self, word: bytes) -> list[int] | None:
        i, n, out, get, lengths = 0, len(word), [], self._greedy.get, self._lengths.get
        while i < n:
            for length in lengths(word[i : i + 2]) or lengths(word[i : i + 1], ()):
                if i + length <= n and (t := get(word[i : i + length])) is not None:
                    out.append(t)
                    i += length
                    break
            else:
                return None
        return out

    def _propose_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at every byte of some words, then the tokens from each word's start on."""
        sizes = np.array(list(map(len, words)), np.int64)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        symbols, inside = np.full(ends[-1] + 1, BORDER, np.int64), np.ones(ends[-1] + 1, bool)
        inside[ends] = False
        symbols[inside] = np.frombuffer(b"".join(words), np.uint8)
        longest = self._ones[symbols]
        steps = (longest >= 0).astype(np.int64)
        node = self._twos[symbols[:-1] * (BORDER + 1) + symbols[1:]]
        at, length = np.flatnonzero(node >= 0), 2
        node = node[at].astype(np.int64)
        while len(at):
            token = self._ends[node]
            hit = token >= 0
            longest[at[hit]], steps[at[hit]] = token[hit], length
            node = self._steps(node * (BORDER + 1) + symbols[at + length])
            on = node != NO_CODE
            at, node, length = at[on], node[on], length + 1
        taken, here = np.zeros(len(symbols), bool), starts
        while len(here := here[inside[here]]):
            taken[here] = True
            here = here[steps[here] > 0]
            here = here + steps[here]
        counts = np.add.reduceat(taken, starts, dtype=np.int64)
        stuck = np.add.reduceat(taken & (steps == 0), starts, dtype=np.int64) > 0
        if stuck.any():
            taken &= ~np.repeat(stuck, sizes + 1)
            counts[stuck] = 0
        return longest[taken].astype(np.int64), counts

    def _propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each word has): greedy longest match; none for a word in which a byte has no token."""
        found, own, n = [], [], 0
        for w in words:
            if len(w) > LONG or n + len(w) > TOGETHER:
                if own:
                    found.append(self._propose_together(own))
                own, n = [], 0
            if len(w) > LONG:
                ids = np.array(self._propose_long(w) or [], np.int64)
                found.append((ids, np.array([len(ids)])))
            else:
                own.append(w)
                n += len(w) + 1
        if own:
            found.append(self._propose_together(own))
        flat, sizes = zip(*found, strict=True) if found else ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
        return np.concatenate(flat), np.concatenate(sizes)

    def _merge_alike(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of up to ``width`` symbols all at once: (rows of ids, how many of each row count)."""
        sizes = np.array(list(map(len, words)), np.int64) - self.word_end
        raw = np.frombuffer(b"".join([w[:width].ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        ids = np.where(columns < sizes[:, None], self._first[0][raw], -1)
        every = np.arange(len(words))
        if self.word_end:
            ids[every, sizes - 1] = self._first[1][raw[every, sizes - 1]]
        codes = np.full((len(words), width), NO_CODE, np.int64)
        pair = np.nonzero(columns[1:] < sizes[:, None])
        codes[pair] = self._codes_of(ids[pair] * self.size + ids[:, 1:][pair])
        out, counts = np.empty_like(ids), sizes.copy()
        while len(every):
            at = codes.argmin(1)  # the first of equals, as the leftmost merges first
            row = np.arange(len(every))
            best = codes[row, at]
            done = best >= NO_CODE
            if done.any():
                out[every[done]] = ids[done]
                every, ids, codes, at, best = every[~done], ids[~done], codes[~done], at[~done], best[~done]
                row = np.arange(len(every))
                if not len(every):
                    break
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, codes = np.take_along_axis(ids, source, 1), np.take_along_axis(codes, source, 1)
            ids[row, at] = best & 0xFFFFF
            counts[every] -= 1
            n = counts[every]
            ids[row, n], codes[row, n] = -1, NO_CODE
            codes[row, n - 1] = NO_CODE
            k = np.flatnonzero(at > 0)
            codes[k, at[k] - 1] = self._codes_of(ids[k, at[k] - 1] * self.size + ids[k, at[k]])
            k = np.flatnonzero(at + 1 < n)
            codes[k, at[k]] = self._codes_of(ids[k, at[k]] * self.size + ids[k, at[k] + 1])
        return out, counts

    def merge_words(self, words: list[bytes], dtype: np.dtype) -> list[bytes]:
        """Exact merging of many words, those of like length together: for each its packed ids."""
        out, by_width = [b""] * len(words), {}
        for k, w in enumerate(words):
            n = len(w) - self.word_end
            if n > 48:
                out[k] = np.array(self.merge_exactly(w), dtype).tobytes()
            elif n:
                by_width.setdefault(4 * -(-n // 4), []).append(k)
        for width, own in by_width.items():
            ids, counts = self._merge_alike([words[k] for k in own], width)
            flat, step = ids.astype(dtype).tobytes(), width * dtype.itemsize
            for r, (k, n) in enumerate(zip(own, (counts * dtype.itemsize).tolist(), strict=True)):
                out[k] = flat[r * step : r * step + n]
        return out

    def encode_words(self, words: list[bytes], dtype: np.dtype) -> list[bytes]:
        """Packed ids of words (pre-tokens, each with its WORD_END where the vocabulary has word ends)."""
        flat, sizes = self._propose(words)
        owner = np.repeat(np.arange(len(words)), sizes)
        sound = sizes > 0
        if len(flat) > 1:
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            sound[owner[inside[~self.compatible(flat[inside], flat[inside + 1])]]] = False
        packed, ends = flat.astype(dtype).tobytes(), np.cumsum(sizes) * dtype.itemsize
        out = [packed[a:b] for a, b in zip((ends - sizes * dtype.itemsize).tolist(), ends.tolist(), strict=True)]
        failing = np.flatnonzero(~sound).tolist()
        for k, ids in zip(failing, self.merge_words([words[k] for k in failing], dtype), strict=True):
            out[k] = ids
        return out


#: The patterns by which the two tokenizer files cut text into words before merging.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BARE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


@lru_cache(maxsize=2)
def _plain_pattern(pattern: str) -> re.Pattern:
    """The pattern for characters up to PLAIN_LIMIT, in Python's faster engine; a line end is a word of its own."""
    plain = "".join(map(chr, range(ord(PLAIN_LIMIT) + 1)))
    letters, digits = "".join(regex.findall(r"\p{L}", plain)), "".join(regex.findall(r"\p{N}", plain))
    other = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{digits}]")
    for kind, own in ((r"\p{L}", letters), (r"\p{N}", digits)):
        other = other.replace(f"[{kind}]", kind).replace(kind, f"[{own}]")
    return re.compile("\n|" + other)


class Codec:
    """Encodes and decodes whole texts as the tokenizers library does with the same file."""

    def __init__(self, path: str, width: int = 4, speculate: bool = True, cache: int = CACHE_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self._most = cache

        self.table, self.dtype = MergeTable(path), np.dtype(f"<u{width}")
        self._encode_words = self.table.encode_words if speculate else self.table.merge_words
        # only asked how it cuts and composes texts, so it gets no tokens to hold
        spec = json.load(open(path, encoding="utf-8"))
        spec["model"] |= {"vocab": {}, "merges": [], "unk_token": None}
        self._library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None}))
        self.bare = self.table.word_end
        self._words = regex.compile(BARE_PATTERN if self.bare else SPACED_PATTERN)
        self._exotic = re.compile(f"[^\x00-{PLAIN_LIMIT}]")
        self._agrees: dict[str, bool] = {}
        self._special = re.compile("|".join(map(re.escape, sorted(self.table.specials, key=len, reverse=True))) or r"(?!)")
        self._separators, self._space = re.compile("[\x1c-\x1f]"), re.compile(r"\s")
        self._plain_words = _plain_pattern(self._words.pattern)
        self._unplain = re.compile(rf"[^\x00-{PLAIN_LIMIT}]|\s")
        self._stop = np.iinfo(self.dtype).max  # no id: stands for a line end between chunks
        self._chunks: dict[str, bytes] = {}
        self._words_known: dict[str, bytes] = {}
        self._firsts: dict[str, bytes] = {}
        self._special_ids = {k: self._pack([v]) for k, v in self.table.specials.items()}

    def _pack(self, ids: Iterable[int]) -> bytes:
        return np.array(list(ids), self.dtype).tobytes()

    def _cut(self, text: str) -> list[str]:
        """Words of a text; the library cuts where a character is one that our regex classes otherwise."""
        for c in () if text.isascii() else set(self._exotic.findall(text)):
            if c not in self._agrees:
                probe = f"x{c}9{c}!{c} "
                theirs = [span for _, span in self._library.pre_tokenizer.pre_tokenize_str(probe)]
                self._agrees[c] = theirs == [m.span() for m in self._words.finditer(probe)]
            if not self._agrees[c]:
                return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]
        return self._words.findall(text)

    def _normal(self, text: str) -> str:
        """Composed and lower case, as the library has it; plain characters are composed already."""
        if not self.bare:
            return text
        return self._library.normalizer.normalize_str(text) if self._exotic.search(text) else text.lower()

    def _raw(self, word: str) -> bytes:
        return word.encode() + (WORD_END if self.bare else b"")

    def _encode_all(self, texts: Iterable[str]) -> dict[str, bytes]:
        """Ids of texts, each cut into words on its own; all words are encoded at once."""
        cut = {t: self._cut(t) for t in texts}
        words = list({w for ws in cut.values() for w in ws})
        ids = dict(zip(words, self._encode_words([self._raw(w) for w in words], self.dtype), strict=True))
        return {t: b"".join([ids[w] for w in ws]) for t, ws in cut.items()}

    def _encode_chunks(self, chunks: list[str], lead: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of chunks, each with ``lead`` before it: of plain ones without white space, cut in one pass over all of them, and of the others."""
        if self.table.size > self._stop:
            plain = []
        elif self._unplain.search("".join(chunks)):
            plain = [c for c in chunks if not self._unplain.search(c)]
        else:
            plain = chunks
        out, other = {}, {}
        if len(plain) < len(chunks):
            new = self._encode_all([lead + c for c in set(chunks).difference(plain)])
            other = {c[len(lead) :]: ids for c, ids in new.items()}
        if plain:
            known = self._words_known
            words = self._plain_words.findall(lead + f"\n{lead}".join(plain) + "\n")
            unknown = set(words).difference(known)
            if len(known) + len(unknown) > self._most // 2:
                known.clear()
                unknown = set(words)
            unknown.discard("\n")
            unknown = list(unknown)
            known.update(zip(unknown, self._encode_words([self._raw(w) for w in unknown], self.dtype), strict=True))
            known["\n"] = self._pack([self._stop])
            flat, step = b"".join(map(known.__getitem__, words)), self.dtype.itemsize
            ends = (np.flatnonzero(np.frombuffer(flat, self.dtype) == self._stop) * step).tolist()
            out.update(zip(plain, [flat[a:b] for a, b in zip([0, *[e + step for e in ends[:-1]]], ends, strict=True)], strict=True))
        return out, other

    def _pieces(self, text: str) -> list[str]:
        """The parts of a text between special tokens, and these, in turn."""
        return self._special.split(text) if "<" in text else [text]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned integers; null counts as empty."""
        return [x for k in range(0, len(texts), GROUP) for x in self._some(texts[k : k + GROUP])]

    def _some(self, texts: list[str | None]) -> list[bytes]:
        split: list[tuple[list[str], list[list[str]]]] = []
        for text in texts:
            pieces = self._pieces(text or "")
            specials = self._special.findall(text) if len(pieces) > 1 else []
            # between 0x1C and 0x1F Python sees white space and the patterns don't
            rows = [p.split() if self.bare and not self._separators.search(p) else p.split(" ") for p in map(self._normal, pieces)]
            split.append((specials, rows))
        known = self._chunks
        chunks: set[str] = set()
        for _, rows in split:
            chunks.update(*rows)
        unknown = chunks.difference(known)
        if len(known) + len(unknown) > self._most:
            known.clear()
            unknown = chunks
        lead = "" if self.bare else " "
        plain, other = self._encode_chunks([c for c in unknown if c], lead)
        known.update(plain)
        known.update(other)
        # chunks with white space hardly ever come again: they are known for these texts only
        mixed = {c for c in other if self._space.search(c)}
        for c in () if self.bare else [c for c in mixed if c[0].isspace() or c[-1].isspace()]:
            del known[c]
            mixed.remove(c)
        if self.bare:
            known[""] = b""
        if not self.bare:
            self._firsts = self._encode_all({row[0] for _, rows in split for row in rows if row[0]})
        joined = [[self._joined(row) for row in rows] for _, rows in split]
        for c in mixed:
            del known[c]
        whole = self._encode_all({" ".join(row) for (_, rows), done in zip(split, joined, strict=True) for row, x in zip(rows, done, strict=True) if x is None})
        out = []
        for (specials, rows), done in zip(split, joined, strict=True):
            parts = [whole[" ".join(row)] if x is None else x for row, x in zip(rows, done, strict=True)]
            for k, special in enumerate(specials):
                parts.insert(2 * k + 1, self._special_ids[special])
            out.append(b"".join(parts))
        return out

    def _joined(self, row: list[str]) -> bytes | None:
        """Ids of chunks that single spaces separate; None if a run of white space reaches over such a space."""
        known = self._chunks
        if self.bare:
            return b"".join(map(known.__getitem__, row))
        first = row[0]
        if first and (first[-1].isspace() or first[0].isspace()):
            return None
        try:
            return (self._firsts[first] if first else b"") + b"".join(map(known.__getitem__, row[1:]))
        except KeyError:  # an empty chunk, or one with white space at an end
            return None

    def forget(self) -> None:
        """Give up what texts so far have left: a worker that goes on to other stages needs its memory."""
        self._chunks, self._words_known, self._firsts = {}, {}, {}
        pa.default_memory_pool().release_unused()

    def decode(self, ids: bytes) -> str:
        """The text of ids; byte sequences that are not UTF-8 become U+FFFD."""
        table = self.table.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, self.dtype).tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, width: int = 4, speculate: bool = True, cache: int = CACHE_CHUNKS) -> Codec:
    """One codec for each worker process and file; without speculation all unknown words are merged exactly."""
    return Codec(path, width, speculate, cache)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers, for every row.

    A null text counts as empty and has no ids; a null key stays null; repeated rows stay; an empty
    table gives an empty one.  Only the two columns named are read, so others may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = c.encode_batch(batch.column(1).to_pylist())
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], names=[key, "n_tokens", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary")


def decode(tokens: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text): the text of each row's ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids binary]): encode and decode in one pass over the texts.

    Both directions run in the same task, so neither ids nor decoded texts are ever shuffled or kept.
    Nulls, empty texts, repeated rows and names as in encode(); texts are read whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for batch in batches:
            rows = []
            for k in range(0, batch.num_rows, GROUP):
                for ids in c.encode_batch(batch.column(1).slice(k, GROUP).to_pylist()):
                    row = (len(ids) // 4, sha(ids).hexdigest(), sha(c.decode(ids).encode()).hexdigest(), ids)
                    rows.append(row[: len(kinds)])
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *kinds])
        c.forget()

    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.binary()} if with_ids else {})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    )
