"""Operator 3: SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding follows the model's merge rules (best score first, leftmost on ties, bytes for characters without a piece, a
space before the text). Each candidate merge that comes off the agenda is skipped with chance rate, apart from all others:
the merges kept before each next skip are drawn from a hash of (seed, document key, place of the word, skip number), by
the geometric law that such skips follow. So occurrences of a word vary freely. Rate 0 gives the library's own
segmentation. Decoding gives back the text whatever was skipped.

A text is cut where no piece of the vocabulary spans the two characters, so no merge is lost. The ids of (word, skipped
merges) are kept in a bounded cache, which changes no result; what it lacks is merged for many words at once, in numpy, or
by a heap for words that are long or hold characters without a piece. A U+2581 in a text, which stands for a space in
pieces, is written as bytes.

Null text counts as empty and has no ids. Rows that repeat a doc_id get equal ids for equal texts. Null doc_id is a key
of its own. An empty table gives no rows. A very long text is encoded whole by one task. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, RATE, SEED, CACHE, NEVER = "▁", 0.1, 20240, 600_000, 2**62
#: Words up to this length are merged together; texts are encoded in runs of about so many characters.
SHORT, RUN, TOGETHER = 20, 400_000, 4096
#: The steps and factors of the hash (splitmix64).
STEP, DRAW, MIX, FULL = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), 2**64 - 1


def gaps(keys: np.ndarray, places: np.ndarray, skips: np.ndarray, rate: float) -> np.ndarray:
    """For each word (its document's key and its place there) how many merges are kept before its skip of that number."""
    if rate <= 0 or rate >= 1:
        return np.full(len(keys), 0 if rate > 0 else NEVER, np.int64)
    x = keys + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP) + skips.astype(np.uint64) * np.uint64(DRAW)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    u = (((x ^ (x >> np.uint64(31))) >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53
    return (np.log(u) / math.log1p(-rate)).astype(np.int64)


def gap(key: int, place: int, skip: int, rate: float) -> int:
    """How many merges are kept between a word's skip number `skip` - 1 and the next."""
    if rate <= 0 or rate >= 1:
        return 0 if rate > 0 else NEVER
    x = (key + (place + 1) * STEP + skip * DRAW) & FULL
    x = (x ^ (x >> 30)) * MIX[0] & FULL
    x = (x ^ (x >> 27)) * MIX[1] & FULL
    return int(math.log((((x ^ (x >> 31)) >> 11) + 1) * 2.0**-53) / math.log1p(-rate))


class _Numbers(dict):
    """Words by number, in the order in which they come up."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Pieces:
    """A SentencePiece BPE model's pieces; the library reads the file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.rank, self.bytes, self.texts = {}, {}, {}, []
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.texts.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                self.texts.append(b"")
            else:
                self.ids[p] = i
                self.rank[p] = -m.get_score(i)
                self.texts.append(p.replace(SPACE, " ").encode())
        joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.joined = joined
        self.coarse = re.compile(r"[▁]*[^\W\d_]+|[▁]+|.", re.S)
        self.breaks = all(p == SPACE * len(p) or SPACE not in p[1:] for p in self.ids)
        self._forget()
        self._pairs()

    def _pairs(self) -> None:
        """A hash table of the pairs of pieces that make a piece, with the rank of the merge; and the piece of each character."""
        self.letter = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        made = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        one, two, whole = (np.array(x, np.int64) for x in zip(*made, strict=True))
        order = np.argsort([self.rank[p] for p in self.ids], kind="stable")
        place = np.empty(len(self.texts), np.float32)
        # equal scores share a rank: the leftmost of them goes first
        scores = np.array([self.rank[p] for p in self.ids])[order]
        place[np.array(list(self.ids.values()))[order]] = np.cumsum(np.concatenate([[0], scores[1:] != scores[:-1]]))
        bits = max(4, int(2 * len(made)).bit_length())
        pairs, self.shift = one << 32 | two, np.uint64(64 - bits)
        self.pair, self.pair_rank, self.pair_piece = np.full(1 << bits, -1, np.int64), np.full(1 << bits, np.inf, np.float32), np.zeros(1 << bits, np.int32)
        todo, at = np.arange(len(made)), self._slot(pairs)
        while len(todo):
            free = self.pair[at] < 0
            self.pair[at[free]] = pairs[todo[free]]
            own = self.pair[at] == pairs[todo]
            self.pair_rank[at[own]], self.pair_piece[at[own]] = place[whole[todo[own]]], whole[todo[own]]
            todo, at = todo[~own], (at[~own] + 1) % len(self.pair)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(STEP)) >> self.shift).astype(np.int64)

    def join(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank (inf: no such piece) and the piece that pairs of pieces make."""
        keys = one.astype(np.int64) << 32 | two
        at = self._slot(keys)
        held = self.pair[at]
        todo = np.nonzero((held != keys) & (held >= 0))[0]
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.pair)
            held = self.pair[at[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
        hit = self.pair[at] == keys
        return np.where(hit, self.pair_rank[at], np.float32(np.inf)), self.pair_piece[at]

    def runs(self, text: str) -> list[str]:
        """text cut wherever no piece spans two neighbours; words that need no cut are found by pattern first."""
        out, joined = [], self.joined
        for w in self.coarse.findall(text):
            if out and out[-1][-1] + w[0] in joined:
                out[-1] += w
            else:
                out.append(w)
        return out

    def cut(self, text: str) -> list[str]:
        """runs() of text whose spaces are SPACE; the runs of what lies between two are kept."""
        if SPACE + SPACE in text or not self.breaks or not text.startswith(SPACE):
            return self.runs(text)
        out, between = [], self.between
        for w in text[1:].split(SPACE):
            found = between.get(w)
            if found is None:
                if len(between) > CACHE:
                    between.clear()
                found = between[w] = self.runs(SPACE + w)
            out += found
        return out

    def merge(self, word: str, skips: Iterator[int]) -> tuple[bytes, int]:
        """Ids of one run of characters, and how many candidate merges came up. skips: the numbers of those to skip, rising."""
        symbols, n = list(word), len(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        get, pop, push, seen, skip = self.rank.get, heapq.heappop, heapq.heappush, -1, next(skips)
        agenda = [(r, i, p) for i, p in enumerate(map(add, symbols, symbols[1:])) if (r := get(p)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, p = pop(agenda)
            s, j = symbols[i], right[i]
            if not s or j >= n or s + symbols[j] != p:
                continue
            seen += 1
            if seen == skip:
                skip = next(skips)
                continue
            symbols[i], symbols[j] = p, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                q = p + symbols[k]
                if (r := get(q)) is not None:
                    push(agenda, (r, i, q))
            h = left[i]
            if h >= 0:
                q = symbols[h] + p
                if (r := get(q)) is not None:
                    push(agenda, (r, h, q))
        ids, own = array("I"), self.ids
        for s in filter(None, symbols):
            if s in own:
                ids.append(own[s])
            else:
                ids.extend([self.bytes[b] for b in s.encode()])
        return ids.tobytes(), seen + 1

    def merge_many(self, words: list[str], keys: np.ndarray, places: np.ndarray, firsts: np.ndarray, rate: float) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """merge() of short words whose characters all have pieces, step by step for all at once: their ids, numbers of
        candidate merges, and how many of those were skipped."""
        sizes = np.array([len(w) for w in words])
        n, width = len(words), int(sizes.max())
        inside = (np.arange(width) < sizes[:, None]).reshape(-1)
        # symbols lie in rows of `width`; one more place stands for what is before the first and after the last
        none = n * width
        here = np.arange(none)
        piece = np.full(none + 1, -1, np.int32)
        piece[:-1][inside] = self.letter[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        after, ahead = np.append(here + 1, none), np.append(here - 1, none)
        after[:-1][(here % width) == np.repeat(sizes - 1, width)] = none
        ahead[:-1:width] = none
        rank, made = np.full(none + 1, np.inf, np.float32), np.zeros(none + 1, np.int32)
        at = here[inside & (after[:-1] < none)]
        rank[at], made[at] = self.join(piece[at], piece[at + 1])
        grid, row = rank[:-1].reshape(n, width), here[::width]
        seen, skips, due = np.zeros(n, np.int64), np.zeros(n, np.int64), firsts.copy()
        while True:
            i = row + grid.argmin(1)
            live = np.nonzero(rank[i] < np.inf)[0]
            if not len(live):
                break
            i = i[live]
            rank[i] = np.inf
            skip = seen[live] == due[live]
            seen[live] += 1
            if skip.any():
                out = live[skip]
                skips[out] += 1
                due[out] += 1 + gaps(keys[out], places[out], skips[out], rate)
                i = i[~skip]
            gone = after[i]
            k, h = after[gone], ahead[i]
            piece[i], piece[gone], rank[gone], after[i], ahead[k] = made[i], -1, np.inf, k, i
            right, left = k < none, h < none
            one, two = np.concatenate([i[right], h[left]]), np.concatenate([k[right], i[left]])
            rank[one], made[one] = self.join(piece[one], piece[two])
        kept = piece[:-1] >= 0
        raw, ends = piece[:-1][kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.reshape(n, width).sum(1))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], seen, skips

    def _forget(self) -> None:
        """Starts the cache anew. Words have numbers; what is known of a word and its skips lies in a slot: its ids (store) and its
        number of candidate merges (count). base: a word's slot without skips; few: slots by _key. Slot 0: not known."""
        self.between, self.number, self.few, self.store = {}, _Numbers(), {}, [b""]
        self.base, self.count = np.zeros(1024, np.int64), np.full(1, NEVER + 1)

    @staticmethod
    def _key(number: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        """One number for a word and its one or two skipped merges; -1 for skips that no kept word has."""
        one = number << 8 | first
        if second is None:
            return np.where(first < 256, one, -1)
        return np.where((first < 256) & (second < 256), one << 8 | second | 1 << 62, -1)

    def _add(self, ids: list[bytes], n: np.ndarray) -> np.ndarray:
        """The slots of new ids."""
        self.store += ids
        self.count = np.concatenate([self.count, n])
        return np.arange(len(self.store) - len(ids), len(self.store))

    def _known(self, number: np.ndarray, draws: list[np.ndarray]) -> np.ndarray:
        """The slot of each word with its draws of skips, 0 where it is not known."""
        slot = self.base[number]
        slot[draws[0] < self.count[slot]] = 0
        for k in (1, 2):
            rest = np.nonzero(slot == 0)[0]
            keys = self._key(number[rest], draws[0][rest], draws[1][rest] if k == 2 else None)
            found = np.fromiter(map(self.few.get, keys.tolist(), repeat(0)), np.int64, len(rest))
            slot[rest] = np.where(draws[k][rest] >= self.count[found], found, 0)
        return slot

    def _skips(self, drawn: list[int], key: int, place: int, rate: float) -> Iterator[int]:
        """The numbers drawn, then more, which are added to drawn."""
        yield from drawn
        while True:
            drawn.append(drawn[-1] + 1 + gap(key, place, len(drawn), rate))
            yield drawn[-1]

    def encode_many(self, texts: list[str], names: list[str], rate: float = RATE, seed: int = SEED) -> list[bytes]:
        """Ids of texts, little-endian uint32. names: the documents' keys."""
        if len(self.store) > CACHE or len(self.number) > CACHE:
            self._forget()
        flat, sizes, own = [], [], []
        for text, name in zip(texts, names, strict=True):
            before = len(flat)
            if text:
                for i, part in enumerate(text.split(SPACE)):
                    part = part.replace(" ", SPACE)
                    if i:
                        flat.append("")
                    flat += self.runs(part) if i else self.cut(SPACE + part)
            sizes.append(len(flat) - before)
            own.append(int.from_bytes(hashlib.blake2b(f"{seed}/{name}".encode(), digest_size=8).digest(), "little"))
        number = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        if len(self.number) > len(self.base):
            self.base = np.concatenate([self.base, np.zeros(len(self.number), np.int64)])
        doc = np.repeat(np.arange(len(texts)), sizes)
        keys, places = np.array(own, np.uint64)[doc], np.arange(len(flat)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        # the numbers of the first three skips of each word
        draws = [gaps(keys, places, np.full(len(flat), k), rate) for k in range(3)] if 0 < rate < 1 else [gaps(keys, places, places, rate)] * 3
        if 0 < rate < 1:
            draws[1] += draws[0] + 1
            draws[2] += draws[1] + 1
        slot = self._known(number, draws) if rate < 1 else np.zeros(len(flat), np.int64)
        where = np.nonzero(slot == 0)[0]
        missing = [flat[i] for i in where.tolist()]
        lengths = np.array([len(w) for w in missing], np.int64)
        letters = self.letter[np.frombuffer("".join(missing).encode("utf-32-le"), np.uint32)] < 0
        strange = np.concatenate([[0], np.cumsum(letters)])
        ends = np.cumsum(lengths)
        plain = (strange[ends] == strange[ends - lengths]) & (lengths <= SHORT) & (lengths > 0)
        for i in where[~plain].tolist():
            w, drawn = flat[i], [int(draws[0][i])]
            if w:
                ids, n = self.merge(w, self._skips(drawn, own[doc[i]], int(places[i]), rate))
                some = self._add([ids], np.array([n]))
                if len(w) < 64 and drawn[0] >= n:
                    self.base[number[i]] = some[0]
            else:  # a U+2581 of the text
                some = self._add([array("I", [self.bytes[b] for b in SPACE.encode()]).tobytes()], np.array([0]))
                self.base[number[i]] = some[0]
            slot[i] = some[0]
        many = where[plain][np.argsort(lengths[plain], kind="stable")]
        for lo in range(0, len(many), TOGETHER):
            some = many[lo : lo + TOGETHER]
            ids, n, skips = self.merge_many([flat[i] for i in some.tolist()], keys[some], places[some], draws[0][some], rate)
            slot[some] = new = self._add(ids, n)
            self.base[number[some[skips == 0]]] = new[skips == 0]
            for k in (1, 2):
                at = skips == k
                names_of = self._key(number[some[at]], draws[0][some[at]], draws[1][some[at]] if k == 2 else None)
                self.few.update(zip(names_of.tolist(), new[at].tolist(), strict=True))
        out, ends = list(map(self.store.__getitem__, slot.tolist())), np.cumsum(sizes).tolist()
        return [b"".join(out[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, text: str, key: str = "", rate: float = RATE, seed: int = SEED) -> bytes:
        """Ids of text, little-endian uint32. key: the document's."""
        return self.encode_many([text], [key], rate, seed)[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the first piece's space, which encoding added, goes."""
        raw = b"".join(map(self.texts.__getitem__, memoryview(ids).cast("I")))
        return raw[1:].decode() if raw else ""


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One model, and cache, for each path in each Python worker."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encoded(model: Pieces, texts: list, ids: list, rate: float, seed: int) -> Iterator[bytes]:
    """The ids of each text, in runs of about RUN characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= RUN or i + 1 == len(texts):
            yield from model.encode_many([x or "" for x in texts[at : i + 1]], [str(x) for x in ids[at : i + 1]], rate, seed)
            at, size = i + 1, 0


def encode(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id and ids (binary, little-endian uint32) of docs (doc_id, text)."""

    def run(batches):
        m = pieces(path)
        for b in batches:
            ids = list(encoded(m, b.column(1).to_pylist(), b.column(0).to_pylist(), rate, seed))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encoded (doc_id, ids)."""

    def run(batches):
        m = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_crc32, lossless: every text encoded, decoded and held against itself."""

    def run(batches):
        m = pieces(path)
        for b in batches:
            rows, names, texts = [], b.column(0).to_pylist(), b.column(1).to_pylist()
            for d, t, ids in zip(names, texts, encoded(m, texts, names, rate, seed), strict=True):
                back = m.decode(ids)
                rows.append((d, len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == (t or "")))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, lossless boolean")
