"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The agenda holds every adjacent pair of symbols whose concatenation is a piece. The best
pair (highest score, leftmost on ties) comes up and is merged, until none is left; with
the dropout rate it is skipped for good instead. Which candidates are skipped is a keyed
hash of (seed, key of the row, number of the word, number of earlier skips in the word):
it gives how many candidates pass before the next one is skipped, which is the same as an
own draw for each candidate. So every word of every row has its own skips, and equal rows
always get equal ids. Rate 0 gives the model's own segmentation.

A merge never crosses two neighbouring characters that no piece holds side by side, so a
text is cut there first and each cut word is encoded alone. What comes of a word and its
skips is kept as a tree, so words that have been met need no agenda, only look-ups.

Spaces are written as U+2581 with one in front of a text, and characters without a piece
become bytes. U+2581 in the text itself is written as bytes, so it comes back as it was,
and ``decode(encode(text)) == text`` holds for every text of valid Unicode.

Defined cases: null gives a null list, empty text the empty list; decoding likewise. A
text of any length is cut some characters at a time. Model files are read by the driver
and shared with the tasks; only BPE models with byte pieces are taken. Repeated rows and
columns of other names do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
KEEP_NODES = 600_000
BLOCK_CHARS = 1_000_000
BLOCK_WORDS = 100_000
SPACE = "▁"
_LITERAL = "\ud800"  # stands for a U+2581 of the text until it is written as bytes; no text holds a lone surrogate
_NONE = np.int32(2**31 - 1)


class PieceModel:
    """Tables of a SentencePiece BPE model."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.size = n
        self.byte_ids = np.full(256, -1, np.int64)
        self.raw: list[bytes] = []
        pieces: dict[str, int] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                pieces[p] = i
                self.raw.append(p.replace(SPACE, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.raw_size = np.array([len(r) for r in self.raw], np.int64)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        # the symbols: pieces, and characters of pieces that are no pieces themselves
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p}):
            symbols.setdefault(c, n + len(symbols))
        self.char_code = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.char_code[ord(c)] = i
        self.is_piece = np.zeros(max(symbols.values()) + 1, bool)
        self.is_piece[list(pieces.values())] = True
        order = sorted(pieces, key=lambda p: -sp.get_score(pieces[p]))
        rank = {p: r for r, p in enumerate(order)}
        self.of_rank = np.array([pieces[p] for p in order], np.int32)
        merges = {}
        self.beside: set[int] = set()
        for p in pieces:
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    merges[(a << 32) | b] = rank[p]
            self.beside.update((ord(x) << 21) | ord(y) for x, y in zip(p, p[1:], strict=False))
        self.pair = np.array(sorted(merges), np.int64)
        self.pair_rank = np.array([merges[k] for k in self.pair.tolist()], np.int32)
        chars = np.array(sorted({c for x in self.beside for c in (x >> 21, x & 0x1FFFFF)}), np.int64)
        self.char_place = np.zeros(0x110000, np.int32)
        self.char_place[chars] = np.arange(1, len(chars) + 1)
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        two = np.array(sorted(self.beside), np.int64)
        self.together[self.char_place[two >> 21], self.char_place[two & 0x1FFFFF]] = True
        self.char_rank = np.full(self.together.shape, _NONE, np.int32)  # of two characters
        self.char_rank[1:, 1:] = self.look_up(np.repeat(self.char_code[chars], len(chars)), np.tile(self.char_code[chars], len(chars))).reshape(len(chars), len(chars))

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged pairs; ``_NONE`` where there is none."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], _NONE)

    def cut_long(self, text: str, size: int = BLOCK_CHARS) -> Iterator[list[str]]:
        """``cut`` of a text of any length, some characters at a time."""
        at = 0
        while at < len(text):
            reach = size
            while True:
                words = self.cut(text[at : at + reach])
                if at + reach >= len(text):
                    at = len(text)
                elif len(words) > 1:  # the last word may go on
                    at += reach - len(words.pop())
                else:
                    reach *= 2
                    continue
                break
            yield words

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes that these ids stand for."""
        size = self.raw_size[ids]
        upto = np.cumsum(size)
        return self.raw_flat[np.repeat(self.raw_first[ids] - (upto - size), size) + np.arange(int(upto[-1]) if len(ids) else 0)].tobytes()

    def cut(self, text: str) -> list[str]:
        """The words of an escaped text, none of whose merges crosses a cut."""
        if not text:
            return []
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        place = self.char_place[code]
        ends = (np.flatnonzero(~self.together[place[:-1], place[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Growing:
    """An array with room to grow; ``a`` is its filled part."""

    def __init__(self, dtype: type):
        self.held, self.n = np.empty(1024, dtype), 0

    @property
    def a(self) -> np.ndarray:
        return self.held[: self.n]

    def extend(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.held):
            self.held = np.concatenate((self.a, np.empty(n, self.held.dtype)))
        self.held[self.n : n] = more
        self.n = n


class Encoder:
    """Encodes texts with one model, rate and seed; keeps the outcomes of words it has met.

    A node is a word with the numbers of the candidates that were skipped in it. It holds
    the ids, the number of candidates that came up after its last skip, and for each of
    them the node in which that one is skipped as well (-1: not met yet).
    """

    def __init__(self, model: PieceModel, dropout: float = DROPOUT, seed: int = SEED, keep: int = KEEP_NODES):
        self.model, self.dropout, self.seed, self.keep = model, dropout, seed, keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.word: list[str] = []
        self.path: list[tuple[int, ...]] = []
        self.first, self.size, self.left, self.base = (_Growing(np.int64) for _ in range(4))
        self.ids, self.child = _Growing(np.int32), _Growing(np.int64)

    def gaps(self, key: np.ndarray, skips: int) -> np.ndarray:
        """How many candidates pass before the next one is skipped, after ``skips`` skips in a word of this key."""
        if self.dropout >= 1:
            return np.zeros(len(key), np.int64)
        with np.errstate(over="ignore"):
            h = _mixed(key + np.uint64(skips + 1) * np.uint64(0xC2B2AE3D27D4EB4F))
        u = ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        return np.minimum(np.floor(np.log(u) / np.log1p(-self.dropout)), 2.0**40).astype(np.int64)

    def word_keys(self, key: int, first: int, count: int) -> np.ndarray:
        """The keys of a row's words number ``first`` on."""
        with np.errstate(over="ignore"):
            row = _mixed(np.array([(key ^ (self.seed * 0x2545F4914F6CDD1D)) & 0xFFFFFFFFFFFFFFFF], np.uint64))
            return _mixed(row + np.arange(first, first + count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def add(self, words: list[str], paths: list[tuple[int, ...]]) -> np.ndarray:
        """New nodes of these words and skips."""
        found = self.merge(words, paths)
        new = np.arange(len(self.word), len(self.word) + len(words))
        self.word += words
        self.path += paths
        sizes = np.array([len(ids) for ids, _ in found], np.int64)
        left = np.array([n for _, n in found], np.int64)
        self.first.extend(self.ids.n + np.cumsum(sizes) - sizes)
        self.size.extend(sizes)
        self.left.extend(left)
        self.base.extend(self.child.n + np.cumsum(left) - left)
        self.ids.extend(np.fromiter(chain.from_iterable(ids for ids, _ in found), np.int32, int(sizes.sum())))
        self.child.extend(np.full(int(left.sum()) if self.dropout > 0 else 0, -1, np.int64))
        return new

    def merge(self, words: list[str], paths: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
        """Per word: its ids when the candidates of these numbers are skipped, and how many came up after the last of them."""
        out: list[tuple[tuple[int, ...], int]] = [((), 0)] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):  # words of like length together, in a bounded table
            longest = len(words[order[at]])
            stop = at
            while stop < len(order) and stop - at < 4096 and len(words[order[stop]]) <= longest + longest // 4 + 1 and (stop == at or (stop - at) * len(words[order[stop]]) < 200_000):
                stop += 1
            ids = order[at:stop]
            if len(ids) == 1 and longest > 2048:
                out[ids[0]] = self._merge_long(words[ids[0]], paths[ids[0]])
            else:
                for i, found in zip(ids, self._merge_table([words[i] for i in ids], [paths[i] for i in ids]), strict=True):
                    out[i] = found
            at = stop
        return out

    def _merge_table(self, words: list[str], paths: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
        m = self.model
        count = np.array([len(w) for w in words])
        wide = int(count.max())
        code = np.zeros((len(words), wide), np.uint32)
        inside = np.arange(wide) < count[:, None]
        code[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = np.where(inside, m.char_code[code], np.int32(-1))
        place = m.char_place[code]
        start = np.broadcast_to(np.arange(wide, dtype=np.int32), sym.shape).copy()  # of each symbol, in characters
        rank = np.full(sym.shape, _NONE, np.int32)
        if wide > 1:
            rank[:, :-1] = np.where(inside[:, 1:], m.char_rank[place[:, :-1], place[:, 1:]], _NONE)
        skips = np.full((len(words), max(map(len, paths)) + 1), -1, np.int64)
        for i, path in enumerate(paths):
            skips[i, : len(path)] = path
        taken, skipped = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        cols = np.arange(max(wide - 1, 0))
        while wide > 1:
            best = rank[live].argmin(1)
            low = rank[live, best]
            going = low < _NONE
            live, best, low = live[going], best[going], low[going]
            if not len(live):
                break
            skip = skips[live, skipped[live]] == taken[live]
            taken[live] += 1
            rank[live[skip], best[skip]] = _NONE
            skipped[live[skip]] += 1
            row, best, low = live[~skip], best[~skip], low[~skip]
            if not len(row):
                continue
            sym[row, best] = m.of_rank[low]
            # close the gap: everything right of the merged pair moves one to the left
            src = row[:, None] * wide + (cols + (cols > best[:, None]))
            for table, fill in ((sym, -1), (rank, _NONE)):
                moved = table.ravel()[src]
                table[row, :-1] = moved
                table[row, -1] = fill
            moved = start.ravel()[src]
            start[row, :-1] = moved
            count[row] -= 1
            for side in (0, 1):
                at = best - side
                ok = (at >= 0) & (at + 1 < count[row])
                r, c = row[ok], at[ok]
                rank[r, c] = m.look_up(sym[r, c], sym[r, c + 1])
                if not side:
                    rank[row[~ok], at[~ok]] = _NONE
        # a shifted start belongs to the symbol it moved with, and the merged one keeps its own
        whole = ((sym >= 0) & m.is_piece[sym]).sum(1) == count
        rows, counts = sym.tolist(), count.tolist()
        left = (taken - np.array([p[-1] + 1 if p else 0 for p in paths])).tolist()
        out = []
        for i, plain in enumerate(whole.tolist()):
            ids = tuple(rows[i][: counts[i]]) if plain else self._ids(sym[i, : counts[i]], start[i, : counts[i]], words[i])
            out.append((ids, left[i]))
        return out

    def _merge_long(self, word: str, path: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        """The same agenda as a heap, for a word too long for a table."""
        m, n = self.model, len(word)
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = m.char_code[code].tolist()
        last, prev, succ = list(range(n)), list(range(-1, n - 1)), [*range(1, n), -1]
        first = m.look_up(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(r, i, i + 1, i + 1) for i, r in enumerate(first.tolist()) if r < _NONE]
        heapq.heapify(heap)
        alive, skips, taken = [True] * n, set(path), 0
        while heap:
            r, i, j, end = heapq.heappop(heap)
            if not (alive[i] and alive[j] and succ[i] == j and last[j] == end) or last[i] != j - 1:
                continue
            taken += 1
            if taken - 1 in skips:
                continue
            sym[i], last[i], alive[j], succ[i] = int(m.of_rank[r]), end, False, succ[j]
            if succ[i] >= 0:
                prev[succ[i]] = i
            for a, b in ((i, succ[i]), (prev[i], i)):
                if a >= 0 and b >= 0:
                    r = int(m.look_up(np.array([sym[a]]), np.array([sym[b]]))[0])
                    if r < _NONE:
                        heapq.heappush(heap, (r, a, b, last[b]))
        at = [i for i in range(n) if alive[i]]
        return self._ids(np.array([sym[i] for i in at]), np.array(at), word), taken - (path[-1] + 1 if path else 0)

    def _ids(self, sym: np.ndarray, first: np.ndarray, word: str) -> tuple[int, ...]:
        m = self.model
        if len(sym) and sym.min() >= 0 and m.is_piece[sym].all():
            return tuple(sym.tolist())
        out: list[int] = []
        for k, s in enumerate(sym.tolist()):
            if s >= 0 and m.is_piece[s]:
                out.append(s)
            else:
                c = word[first[k]]
                out += m.byte_ids[list((SPACE if c == _LITERAL else c).encode("utf-8", "surrogatepass"))].tolist()
        return tuple(out)

    def _nodes(self, words: list[str], keys: np.ndarray) -> np.ndarray:
        """The node of every word under its key."""
        known = self.known
        found = [known.get(w, -1) for w in words]
        node = np.array(found, np.int64)
        missing = np.flatnonzero(node < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing.tolist()]))
            known.update(zip(new, self.add(new, [()] * len(new)).tolist(), strict=True))
            node[missing] = [known[words[i]] for i in missing.tolist()]
        if self.dropout <= 0:
            return node
        live, skips = np.arange(len(node)), 0
        while len(live):
            gap = self.gaps(keys[live], skips)
            hit = gap < self.left.a[node[live]]
            live, gap = live[hit], gap[hit]
            at = self.base.a[node[live]] + gap
            fresh = np.flatnonzero(self.child.a[at] < 0)
            if len(fresh):
                slot, one = np.unique(at[fresh], return_index=True)
                of, on = node[live[fresh[one]]].tolist(), gap[fresh[one]].tolist()
                paths = [(*self.path[k], (self.path[k][-1] + 1 if self.path[k] else 0) + g) for k, g in zip(of, on, strict=True)]
                made = self.add([self.word[k] for k in of], paths)
                self.child.a[slot] = made
            node[live] = self.child.a[at]
            skips += 1
        return node

    def encode_flat(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        words: list[str] = []
        held: list[tuple[int, int]] = []  # text, words
        own: list[np.ndarray] = []

        def flush() -> None:
            if not words:
                return
            node = self._nodes(words, np.concatenate(own))
            size = self.size.a[node]
            upto = np.cumsum(size)
            parts.append(self.ids.a[np.repeat(self.first.a[node] - (upto - size), size) + np.arange(upto[-1])])
            at = 0
            for t, n in held:
                sizes[t] += upto[at + n - 1] - (upto[at - 1] if at else 0)
                at += n
            words.clear(), held.clear(), own.clear()
            if len(self.word) > self.keep:
                self._forget()

        for t, (text, key) in enumerate(zip(texts, keys, strict=True)):
            number = 0
            for some in self.model.cut_long(SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)) if text else ():
                words += some
                held.append((t, len(some)))
                own.append(self.word_keys(key, number, len(some)))
                number += len(some)
                if len(words) > BLOCK_WORDS:
                    flush()
        flush()
        return np.concatenate(parts) if parts else np.empty(0, np.int32), sizes

    def encode(self, texts: list[str | None], keys: list[int]) -> list[list[int] | None]:
        """Ids of each text; ``keys`` are the rows' keys for the skips."""
        flat, sizes = self.encode_flat(texts, keys)
        ends = np.cumsum(sizes)
        return [None if text is None else flat[e - n : e].tolist() for text, e, n in zip(texts, ends.tolist(), sizes.tolist(), strict=True)]

    def decode(self, ids: list[int] | np.ndarray | None) -> str | None:
        if ids is None:
            return None
        text = self.model.bytes_of(np.asarray(ids, np.int64)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def load(path: str = MODEL) -> bytes:
    """The model file's bytes, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(proto: bytes, dropout: float, seed: int) -> Encoder:
    """This worker's encoder; the next task finds the words it has encoded."""
    key = (xxhash.xxh64_intdigest(proto), dropout, seed)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(PieceModel(proto), dropout, seed)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, proto: bytes, dropout: float = DROPOUT, seed: int = SEED, check: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array<int>), n_ids, lossless (the ids decode to the very text) and the columns ``carry`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    kept = [f"carry{i}" for i in range(len(carry))]

    def encoded(encoder: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        flat, sizes = encoder.encode_flat(texts, b.column("key").to_pylist())
        ends = np.cumsum(sizes)
        none = np.array([t is None for t in texts], bool)
        good = [encoder.decode(flat[e - n : e]) == t if t is not None else True for t, e, n in zip(texts, ends.tolist(), sizes.tolist(), strict=True)] if check else [None] * len(texts)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(none))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(sizes, pa.int32(), mask=none), pa.array(good, pa.bool_()), *map(b.column, kept)], names=["doc_id", "ids", "n_ids", "lossless", *carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a reused worker may still hold what earlier stages left
        gc.collect()
        pa.default_memory_pool().release_unused()
        encoder = _encoder(shared.value, dropout, seed)
        gc.disable()  # nothing here is cyclic, and passes over the kept words cost much
        try:
            for batch in batches:
                at, chars = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                while at < batch.num_rows:  # so many bytes at a time, or one longer text
                    stop = max(at + 1, int(np.searchsorted(chars, (chars[at - 1] if at else 0) + BLOCK_CHARS, side="right")))
                    yield encoded(encoder, batch.slice(at, stop - at))
                    at = stop
        finally:
            gc.enable()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, kept, strict=True)])
    schema = "doc_id long, ids array<int>, n_ids int, lossless boolean"
    return spread(rows).mapInArrow(run, ", ".join([schema, *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]]))


def decode_documents(rows: DataFrame, proto: bytes) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    shared = rows.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(PieceModel(shared.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([encoder.decode(i) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
