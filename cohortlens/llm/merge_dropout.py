"""SentencePiece encoding and decoding with seeded merge-dropout (operator 6).

Encoding processes an agenda of candidate merges, best score first and leftmost among equals. With dropout,
each candidate of each occurrence of a word is skipped by a draw of its own. The draws are gaps between
skips, geometric by the rate, from a hash of (seed, document, place of the word, number of the skip), so a
text's segmentation depends on seed, id and text, not on tasks, order or caches. At rate 0 the ids are those
of the library.

Tables are encoded by ``Arrays``, which takes the agendas of thousands of words through one candidate at a
time together, in numpy; what a process keeps is the words' ids without skips. Each occurrence with a skip has a
run of its own. ``Codec.encode`` gives the same ids for one text, an agenda after the other; it keeps a tree
for each short word: its ids without skips, and below them the ids for each set of skips met so far.

Decoding is lossless: characters without a piece, and a literal U+2581, are written as bytes. Merges never
cross the start of a word, as no piece of the vocabulary goes on beyond one.

Null texts are empty: no ids, decoded as empty text. Repeated rows give equal ids, as they share id and
text. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_process, read_table

SPACE = "▁"
# Words and nodes of skips kept in a process, and draws in the table of gaps; none changes a result.
CACHED = 700_000
CACHED_SKIPS = 300_000
_DRAWS = 4096
# Bytes of text encoded together, places of words merged together, the longest word in arrays and the longest kept.
_TOGETHER = 1 << 22
_CELLS = 1 << 17
_LONGEST = 1000
_SHORT = 32
# A part merged into another or past a word's end, and the most places of a candidate: ten bits, counted down.
_GONE, _PLACES = 2**31 - 1, 1023
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


_NONE = float("-inf")


_WORD = 2**64 - 1
_PLACE, _SKIP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _mix(x):
    """The finaliser of splitmix64, for an int below 2**64 or an array of uint64."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WORD
    return x ^ (x >> 31)


def _bits(skips: int) -> Iterator[int]:
    """Places of the set bits, ascending."""
    while skips:
        low = skips & -skips
        yield low.bit_length() - 1
        skips ^= low


class Codec:
    """A SentencePiece BPE model's pieces and scores, with dropout."""

    def __init__(self, model_path: str, rate: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.rate, self.seed = rate, seed
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        self.raw: list[bytes] = [b""] * size
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.bytes[value], self.raw[k] = k, bytes([value])
            elif not (model.is_control(k) or model.is_unknown(k)):
                self.ids[piece], self.score[piece] = k, model.get_score(k)
                self.raw[k] = piece.replace(SPACE, " ").encode()
        # gaps[k]: of 2**63 draws, how many have their first skip among the first k + 1 candidates.
        part, whole = float(rate).as_integer_ratio()
        none = 2**63
        self.gaps: list[int] = []
        while part and none and len(self.gaps) < _DRAWS:
            none = none * (whole - part) // whole
            self.gaps.append(2**63 - none)
        self.gap_table = np.array(self.gaps, np.uint64)
        self.cache: dict[str, list] = {}
        self.kept = 0

    def first_gaps(self, key: int, place: int, n: int):
        """Candidates before the first skip, for n words from a place on; ``len(gaps)`` stands for as many or more."""
        if not self.gaps:
            return repeat(_DRAWS, n)
        at = np.arange(place, place + n, dtype=np.uint64) * np.uint64(_PLACE) + np.uint64(key)
        return np.searchsorted(self.gap_table, _mix(at) >> np.uint64(1), "right").tolist()

    def next_gap(self, key: int, place: int, skip: int) -> int:
        """Candidates between skip number ``skip`` - 1 and the next."""
        return bisect_right(self.gaps, _mix((key + place * _PLACE + skip * _SKIP) & _WORD) >> 1)

    def skip_places(self, key: int, place: int, gap: int) -> Iterator[int]:
        """All skips of a word, as the places of candidates in the order of the agenda."""
        at = skip = 0
        while self.gaps:
            at += gap
            if gap < len(self.gaps):
                yield at
                at += 1
            skip += 1
            gap = self.next_gap(key, place, skip)

    def _merge_short(self, chunk: str, skips: int) -> tuple[list[str], int]:
        """Pieces, and how many candidates came up; the agenda as a list of the neighbours' scores."""
        get, none = self.score.get, _NONE
        parts = list(chunk)
        agenda = [get(both, none) for both in map(str.__add__, chunk, chunk[1:])]
        seen = 0
        while agenda:
            best = max(agenda)
            if best == none:
                break
            k = agenda.index(best)
            seen += 1
            if skips:
                skip, skips = skips & 1, skips >> 1
                if skip:
                    agenda[k] = none
                    continue
            parts[k] = left = parts[k] + parts[k + 1]
            del parts[k + 1], agenda[k]
            if k:
                agenda[k - 1] = get(parts[k - 1] + left, none)
            if k < len(agenda):
                agenda[k] = get(left + parts[k + 1], none)
        return parts, seen

    def _merge_long(self, chunk: str, skips: int) -> tuple[list[str], int]:
        return self._merge_heap(chunk, _bits(skips))

    def _merge_heap(self, chunk: str, skips: Iterator[int]) -> tuple[list[str], int]:
        """As ``_merge_short``, with the agenda as a heap and skips as they come."""
        score = self.score
        seen, skip = 0, next(skips, -1)
        parts = list(chunk)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        agenda = [(-score[both], k, k + 1, 2) for k in range(n - 1) if (both := chunk[k : k + 2]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue  # one of them has been merged since
            seen += 1
            if seen - 1 == skip:
                skip = next(skips, -1)
                continue
            parts[left] += parts[right]
            parts[right] = ""
            nxt = after[right]
            after[left] = nxt
            for a, b in ((before[left], left), (left, nxt)):
                if a >= 0 and b >= 0:
                    both = parts[a] + parts[b]
                    if both in score:
                        heapq.heappush(agenda, (-score[both], a, b, len(both)))
            if nxt >= 0:
                before[nxt] = left
        return [p for p in parts if p], seen

    def piece_ids(self, pieces: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def node(self, chunk: str, skips: int) -> list:
        """[candidates that came up, ids, nodes by the next skip] of a short word."""
        pieces, seen = self._merge_short(chunk, skips) if len(chunk) <= 24 else self._merge_long(chunk, skips)
        return [seen, self.piece_ids(pieces), None]

    def skip_bits(self, chunk: str, key: int, place: int, gap: int) -> int:
        """All skips of a short word: fewer than three times its length of candidates come up."""
        skips, most = 0, 3 * len(chunk)
        if gap < most:
            for at in self.skip_places(key, place, gap):
                if at >= most:
                    break
                skips |= 1 << at
        return skips

    def varied(self, node: list, chunk: str, gap: int, key: int, place: int) -> tuple[int, ...]:
        """Ids of a short word whose first skip falls on one of its candidates."""
        at, skips, skip = gap, 0, 0
        while at < node[0]:
            skips |= 1 << at
            if node[2] is None:
                node[2] = {}
            below = node[2].get(at)
            if below is None:
                if self.kept >= CACHED_SKIPS:
                    return self.node(chunk, self.skip_bits(chunk, key, place, gap))[1]
                self.kept += 1
                below = node[2][at] = self.node(chunk, skips)
            node = below
            skip += 1
            at += 1 + self.next_gap(key, place, skip)
        return node[1]

    def encode(self, text: str, key: int) -> list[int]:
        """Ids of a whole text; ``key`` (of its document) and the places of its words vary the segmentation."""
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        key = _mix((_mix((self.seed * _SKIP + 1) & _WORD) + key * _PLACE) & _WORD)
        place = 0
        for k, segment in enumerate(text.split(SPACE)):
            if k:
                out += [self.bytes[b] for b in SPACE.encode()]
            else:
                segment = " " + segment
            chunks = _CHUNK.findall(segment.replace(" ", SPACE))
            for place, (chunk, gap) in enumerate(zip(chunks, self.first_gaps(key, place, len(chunks))), place):
                node = cache.get(chunk)
                if node is None:
                    if len(chunk) > 32:
                        out += self.piece_ids(self._merge_heap(chunk, self.skip_places(key, place, gap))[0])
                        continue
                    node = self.node(chunk, self.skip_bits(chunk, key, place, gap))
                    if gap >= node[0]:
                        if len(cache) >= CACHED:
                            cache.clear()
                            self.kept = 0
                        cache[chunk] = node
                    out += node[1]
                    continue
                out += node[1] if gap >= node[0] else self.varied(node, chunk, gap, key, place)
            place += bool(chunks)
        return out

    def decode(self, ids) -> str:
        """The text of ids, without the space put before it."""
        raw = self.raw
        return b"".join([raw[k] for k in ids])[1:].decode("utf-8", "surrogatepass")


class Arrays:
    """Encodes many texts at once, to the same ids as ``Codec.encode``.

    The parts of words are the columns of a matrix: numbers of pieces, or the size of the vocabulary plus the
    code point of a character without a piece. A second matrix holds each part's candidate with the next part as
    one number, by score, then leftmost, then the piece it makes: a column's maximum is what its agenda has next.
    """

    def __init__(self, codec: Codec):
        self.codec, self.size = codec, len(codec.raw)
        self.letter = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, k in codec.ids.items():
            if len(piece) == 1:
                self.letter[ord(piece)] = k
        self.byte_ids = np.array(codec.bytes, np.int64)
        self.raw = np.empty(self.size, object)
        self.raw[:] = codec.raw
        self._pair_table()
        self._forget()

    def _pair_table(self) -> None:
        """Open addressing from two parts to rank << 42 | piece; equal scores have equal ranks."""
        ids, score = self.codec.ids, self.codec.score
        part = lambda p: ids[p] if p in ids else self.size + ord(p) if len(p) == 1 else None
        rank = {x: n for n, x in enumerate(sorted(set(score.values())))}
        keys, values = [-1], [-1]
        for piece, k in ids.items():
            for cut in range(1, len(piece)):
                left, right = part(piece[:cut]), part(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank[score[piece]] << 42 | k)
        self.keys, self.values = np.array(keys, np.int64), np.array(values, np.int64)
        bits = (8 * len(keys)).bit_length()
        self.slots, self.last, self.shift = np.zeros(1 << bits, np.int32), (1 << bits) - 1, np.uint64(64 - bits)
        left = np.arange(1, len(keys), dtype=np.int32)
        at = self._slot(self.keys[1:])
        while left.size:
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], at[lost] + 1 & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_PLACE) >> self.shift).view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 42 | piece of two parts each, -1 if they make none."""
        key = left << 32 | right
        at = self._slot(key)
        entry = self.slots[at]
        same = self.keys[entry] == key
        out = np.where(same, self.values[entry], -1)
        todo = np.flatnonzero(~same & (entry != 0))
        while todo.size:
            at[todo] = at[todo] + 1 & self.last
            entry = self.slots[at[todo]]
            same = self.keys[entry] == key[todo]
            out[todo[same]] = self.values[entry[same]]
            todo = todo[~same & (entry != 0)]
        return out

    def _forget(self) -> None:
        """Words: where their letters start, how many, draws below which a skip falls on a candidate, ids."""
        self.index: dict[str, int] = {}
        self.first, self.length, self.start, self.count = (np.zeros(0, np.int64) for _ in range(4))
        self.below = np.zeros(0, np.uint64)
        self.letters, self.links, self.known = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, words: list[str]) -> None:
        """Keep words: without the space before them, or after a blank if they have none; a blank is a literal U+2581."""
        chunks = ["" if w == " " else w[1:] if w[:1] == " " else SPACE + w for w in words]
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        held = np.where(length <= _LONGEST, length, 0)
        first = np.cumsum(held) - held
        letters = self.letter[np.frombuffer("".join([c for c in chunks if len(c) <= _LONGEST]).encode("utf-32-le"), np.uint32)]
        links = np.full(letters.size, -1, np.int64)
        links[:-1] = self.pairs(letters[:-1], letters[1:])
        links[(first + held - 1)[held > 0]] = -1
        first += self.letters.size
        self.letters, self.links = np.concatenate([self.letters, letters]), np.concatenate([self.links, links])
        below, count = np.where(length > _SHORT, np.uint64(2**63), np.uint64(0)), np.zeros(len(words), np.int64)
        short = np.flatnonzero((length > 0) & (length <= _SHORT))
        short = short[np.argsort(length[short], kind="stable")]
        seen, ids, count[short] = self.merge(first[short], length[short], None, None)
        if self.codec.gaps:
            table = self.codec.gap_table
            below[short] = np.where(seen > 0, table[np.minimum(seen, table.size) - 1], np.uint64(0))
        start = np.zeros(len(words), np.int64)
        start[short] = np.cumsum(count[short]) - count[short] + self.known.size
        literal = np.flatnonzero(length == 0)
        start[literal], count[literal] = self.known.size + ids.size, len(SPACE.encode())
        self.known = np.concatenate([self.known, ids, *[self.byte_ids[list(SPACE.encode())]] * bool(literal.size)])
        for name, more in (("first", first), ("length", length), ("start", start), ("count", count), ("below", below)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def _gaps(self, base: np.ndarray, skip: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codec.gap_table, _mix(base + skip.view(np.uint64) * np.uint64(_SKIP)) >> np.uint64(1), "right")

    def merge(self, first: np.ndarray, length: np.ndarray, base: np.ndarray | None, due: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates that came up, ids of all words, ids a word; shortest words first. ``due``: the place of the first skip."""
        seen, ids, counts, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < length.size:
            part = slice(at, at + max(64, _CELLS // int(length[at] + 2)))
            s, pieces, n = self._merge_some(first[part], length[part], *((None, None) if due is None else (base[part], due[part])))
            ids.append(self._piece_ids(pieces, n))
            seen.append(s)
            counts.append(n)
            at = part.stop
        return np.concatenate(seen), np.concatenate(ids), np.concatenate(counts)

    def _merge_some(self, first, length, base, due):
        w, most = length.size, int(length[-1])
        parts, agenda = np.full((most + 2, w), _GONE, np.int64), np.full((most + 2, w), -1, np.int64)
        places = np.repeat(np.arange(_PLACES, _PLACES - most - 2, -1, dtype=np.int64) << 32, w)
        for k in range(most):
            has = int(np.searchsorted(length, k, "right"))
            parts[k + 1, has:] = self.letters[first[has:] + k]
            agenda[k + 1, has:] = self.links[first[has:] + k] | places[(k + 1) * w]
        part, cand = parts.reshape(-1), agenda.reshape(-1)
        after = np.arange(w, part.size + w)
        before = np.arange(-w, part.size - w)
        seen = np.zeros(w, np.int64)
        skip = np.zeros(w, np.int64)
        due = None if due is None else due.copy()
        rows = np.arange(w)
        turn = 0
        while True:
            if 4 * rows.size > w:
                best = agenda.max(axis=0)
                rows = np.flatnonzero(best >= 0)
                best = best[rows]
            else:
                best = agenda[:, rows].max(axis=0)
                live = best >= 0
                rows, best = rows[live], best[live]
            if not rows.size:
                break
            seen[rows] = turn + 1
            at = (_PLACES - (best >> 32 & _PLACES)) * w + rows
            if due is not None:
                hit = due[rows] == turn
                if hit.any():
                    r = rows[hit]
                    cand[at[hit]] = -1
                    skip[r] += 1
                    due[r] = turn + 1 + self._gaps(base[r], skip[r])
                    at, best = at[~hit], best[~hit]
            turn += 1
            made = best & 0xFFFFFFFF
            right, left = after[at], before[at]
            nxt = after[right]
            part[at] = made
            part[right] = _GONE
            cand[right] = -1
            after[at] = nxt
            before[nxt] = at
            links = self.pairs(np.concatenate([made, part[left]]), np.concatenate([part[nxt], made]))
            cand[at] = links[: at.size] | places[at]
            cand[left] = links[at.size :] | places[left]
        kept = np.ascontiguousarray(parts[1:-1].T)
        there = kept != _GONE
        return seen, kept[there], there.sum(axis=1)

    def _piece_ids(self, pieces: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of parts, bytes for those without a piece; ``counts``, parts a word, become ids a word."""
        odd = pieces >= self.size
        if not odd.any():
            return pieces
        code = pieces[odd] - self.size
        n = np.ones(pieces.size, np.int64)
        n[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.repeat(pieces, n)
        out[np.repeat(odd, n)] = self.byte_ids[np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass"), np.uint8)]
        counts[:] = np.diff(np.cumsum(n)[np.cumsum(counts) - 1], prepend=0)
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words of a text with U+2581 or without a single space between words, as ``_learn`` takes them."""
        out = []
        for k, segment in enumerate(text.split(SPACE) if text else ()):
            if k:
                out.append(" ")
            else:
                segment = " " + segment
            out += [c[1:] if c[0] == SPACE else " " + c for c in _CHUNK.findall(segment.replace(" ", SPACE))]
        return out

    def encode(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's end; ``keys``, of their documents, as in ``Codec.encode``."""
        if len(self.index) >= CACHED or self.letters.size >= 8 * max(CACHED, 1):
            self._forget()
        texts = texts.fill_null("")
        words = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        odd = pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False)
        blank = np.flatnonzero(pc.binary_length(words.flatten()).to_numpy(zero_copy_only=False) == 0)
        odd[np.searchsorted(np.cumsum(sizes), blank, "right")] = True
        if odd.any():
            own = pa.array([self._words(t) for t in texts.filter(pa.array(odd)).to_pylist()], words.type)
            order = np.argsort(odd, kind="stable")
            back = np.empty_like(order)
            back[order] = np.arange(order.size)
            words = pa.concat_arrays([words.filter(pa.array(~odd)), own]).take(pa.array(back))
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        met = coded.dictionary.to_pylist()
        new = [m for m in met if m not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self._learn(new)
        word = np.fromiter(map(self.index.__getitem__, met), np.int64, len(met))[coded.indices.to_numpy(zero_copy_only=False)]

        ends = np.cumsum(sizes)
        place = np.arange(word.size) - np.repeat(ends - sizes, sizes)
        if odd.any():  # a literal U+2581 takes no place
            taken = np.cumsum(np.append(0, self.length[word] > 0))
            place = taken[:-1] - np.repeat(taken[ends - sizes], sizes)
        seed = np.uint64(_mix((self.codec.seed * _SKIP + 1) & _WORD))
        base = np.repeat(_mix(seed + keys.view(np.uint64) * np.uint64(_PLACE)), sizes) + place.view(np.uint64) * np.uint64(_PLACE)
        draw = _mix(base) >> np.uint64(1)
        own = np.flatnonzero(draw < self.below[word])
        own = own[np.argsort(np.minimum(self.length[word[own]], 2 * _LONGEST).astype(np.uint16), kind="stable")]
        length = self.length[word[own]]
        due = np.searchsorted(self.codec.gap_table, draw[own], "right") if self.codec.gaps else np.full(own.size, -1)
        arrays = int(np.searchsorted(length, _LONGEST, "right"))
        _, ids, n = self.merge(self.first[word[own[:arrays]]], length[:arrays], base[own[:arrays]], due[:arrays])
        longer = []
        if arrays < own.size:
            doc = np.searchsorted(ends, own[arrays:], "right")
            names = coded.dictionary.take(coded.indices.take(pa.array(own[arrays:]))).to_pylist()
            for o, d, name, gap in zip(own[arrays:].tolist(), doc.tolist(), names, due[arrays:].tolist()):
                key = _mix((int(seed) + int(keys[d]) * _PLACE) & _WORD)
                chunk = name[1:] if name[:1] == " " else SPACE + name
                pieces, _ = self.codec._merge_heap(chunk, self.codec.skip_places(key, int(place[o]), gap))
                longer.append(np.array(self.codec.piece_ids(pieces), np.int64))
        count, start = self.count[word], self.start[word]
        count[own] = np.concatenate([n, np.fromiter(map(len, longer), np.int64, len(longer))])
        start[own] = np.cumsum(count[own]) - count[own] + self.known.size
        until = np.append(0, np.cumsum(count))
        out = np.concatenate([self.known, ids, *longer])[np.repeat(start - until[:-1], count) + np.arange(until[-1])]
        return out.astype("<i4"), until[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """As ``Codec.decode``, of many texts."""
        raw, at = self.raw[ids].tolist(), 0
        for end in ends.tolist():
            yield b"".join(raw[at:end])[1:].decode("utf-8", "surrogatepass")
            at = end


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of a batch of doc_id and text, some MB of text at a time, and their documents' keys."""
    size = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // _TOGETHER)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
        if a < b:
            yield (rows := batch.slice(a, b - a)), rows.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def load(model_path: str, rate: float, seed: int) -> Codec:
    return per_process(("merge dropout", model_path, rate, seed), lambda: Codec(model_path, rate, seed))


def load_arrays(model_path: str, rate: float, seed: int) -> Arrays:
    return per_process(("merge dropout in arrays", model_path, rate, seed), lambda: Arrays(load(model_path, rate, seed)))


def encode(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = load_arrays(model_path, rate, seed)
        for batch in batches:
            for rows, keys in _portions(batch):
                ids, ends = arrays.encode(rows.column(1), keys)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path, 0.0, 0)
        for batch in batches:
            texts = [codec.decode(x.as_py() or ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), lossless: encoded and decoded in one reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = load_arrays(model_path, rate, seed)
        for batch in batches:
            for rows, keys in _portions(batch):
                ids, ends = arrays.encode(rows.column(1), keys)
                starts = np.append(0, ends)[:-1]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                same = [back == (t.as_py() or "") for back, t in zip(arrays.decode(ids, ends), rows.column(1))]
                columns = [rows.column(0), pa.array(ends - starts), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "lossless"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")


def op6_merge_dropout(spark, sf_dir):
    """Every whole document, encoded with a dropout of 0.1 and decoded."""
    import public_tokenizers

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
