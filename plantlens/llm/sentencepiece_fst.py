"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled once per worker from the model file:

* the normaliser: a space, and the meta symbol in the text, become the meta symbol, and one is put before the text;
* the pieces as a deterministic transducer over characters (a trie), and byte fallback for other characters;
* weights.  A unigram model gives each piece its negative score.  A merge model (BPE) is a bigram acceptor: after
  piece a, piece b costs nothing if merging the characters of ab gives back a and b, and is barred otherwise.  A
  path without barred steps is the tokenisation that merging in order of score gives, and it is the only one.
  The acceptor is composed lazily: the weight of a step is computed when first met, and kept.

An input is composed with it and the path of least weight in the tropical semiring is taken.  Texts are first cut
where no piece can lie across (two neighbouring characters that are side by side in no piece); different
stretches of a batch go through the shortest-path recursion together, position by position.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plantlens.llm.common import RollingHash, keyed, mix, text_groups

# Fixed values of the model file format: field numbers and piece types.
PIECES_FIELD, TRAINER_FIELD, NORMALIZER_FIELD = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
META = 0x2581
# Stretches that a worker remembers; beyond, it starts anew.
REMEMBERED = 1_000_000
# Slots of the table in which steps of the bigram acceptor are looked up first.
SLOT_BITS = 20


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, raw[at : at + size]
        at += size


class Transducer:
    """Compiled model: ``encode`` and ``decode`` groups of texts."""

    def __init__(self, model: bytes) -> None:
        texts, scores, types = [], [], []
        self.kind, prefix, extra, escape, table = UNIGRAM, True, False, True, b""
        for field, value in _fields(model):
            if field == PIECES_FIELD:
                piece = dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                types.append(piece.get(3, NORMAL))
            elif field == TRAINER_FIELD:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == NORMALIZER_FIELD:
                spec = dict(_fields(value))
                table, prefix, extra, escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if table or extra or not escape or self.kind not in (UNIGRAM, BPE) or USER_DEFINED in types:
            raise ValueError("only models with the identity normaliser and escaped spaces, without user-defined pieces, are compiled")
        self.prefix, self.size = prefix, len(texts)
        self.unknown = types.index(UNKNOWN)
        bytes_at = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(texts, types, strict=True)) if k == BYTE}
        self.byte_ids = np.array([bytes_at.get(b, self.unknown) for b in range(256)])
        self.fallback = len(bytes_at) == 256
        normal = [i for i, k in enumerate(types) if k == NORMAL]
        self._compile(texts, scores, normal)
        outputs = [b""] * self.size
        for i in normal:
            outputs[i] = texts[i].replace(chr(META), " ").encode()
        for b, i in bytes_at.items():
            outputs[i] = bytes([b])
        outputs[self.unknown] = " ⁇ ".encode()
        self.out_size = np.array([len(x) for x in outputs])
        self.out_first = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(outputs), np.uint8)
        self._forget()
        self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.slot_keys, self.slot_good = np.full(1 << SLOT_BITS, -1), np.zeros(1 << SLOT_BITS, bool)

    def _compile(self, texts: list[str], scores: list[float], normal: list[int]) -> None:
        letters = sorted({c for i in normal for c in texts[i]})
        self.letters = len(letters) + 1  # 0: any other character
        self.letter_of = np.zeros(0x110000, np.int32)
        self.letter_of[[ord(c) for c in letters]] = np.arange(1, self.letters)
        spelled = {i: self.letter_of[[ord(c) for c in texts[i]]].tolist() for i in normal}
        self.beside = np.zeros((self.letters, self.letters), bool)
        next_node, self.final = {}, [-1]
        for i in normal:
            node = 0
            for c in spelled[i]:
                key = node * self.letters + c
                if key not in next_node:
                    next_node[key] = len(self.final)
                    self.final.append(-1)
                node = next_node[key]
            self.final[node] = i
            self.beside[spelled[i][:-1], spelled[i][1:]] = True
        self.final = np.array(self.final)
        keys = np.array(sorted(next_node), np.int64)
        self.arc_keys, self.arc_to = keys, np.array([next_node[k] for k in keys.tolist()])
        # symbols: pieces, then single letters that are no piece
        single = np.arange(self.letters) + self.size
        for i in normal:
            if len(spelled[i]) == 1:
                single[spelled[i][0]] = i
        self.symbol_of_letter = single
        self.score = np.zeros(self.size + self.letters)
        self.score[: self.size] = scores
        symbol = {texts[i]: i for i in normal} | {c: int(single[k + 1]) for k, c in enumerate(letters)}
        merges = {}
        for i in normal:
            for cut in range(1, len(texts[i])):
                a, b = symbol.get(texts[i][:cut]), symbol.get(texts[i][cut:])
                if a is not None and b is not None:
                    merges[a * (self.size + self.letters) + b] = i
        self.merge_keys = np.array(sorted(merges), np.int64)
        self.merge_to = np.array([merges[k] for k in self.merge_keys.tolist()])
        width = max((len(s) for s in spelled.values()), default=1)
        self.spelling = np.full((self.size + self.letters, width), -1, np.int32)
        for i in normal:
            self.spelling[i, : len(spelled[i])] = single[spelled[i]]
        raw = np.arange(self.letters)
        self.spelling[self.size + raw, 0] = self.size + raw
        self.spelled_size = (self.spelling >= 0).sum(axis=1)

    def _forget(self) -> None:
        self.known, self.known_first, self.known_size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.known_ids = np.zeros(0, np.int32)

    def _merged(self, symbols: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Whether merging the rows of symbols (-1: none) ends in ``goal`` symbols cut after the first part's length."""
        first_len, rows = goal, symbols.copy()
        size = (rows >= 0).sum(axis=1)
        span = np.where(rows >= 0, 1, 0)  # letters of each symbol
        good = np.zeros(len(rows), bool)
        live = np.arange(len(rows))
        worst = -np.inf
        while len(live):
            a, b = rows[live, :-1].astype(np.int64), rows[live, 1:].astype(np.int64)
            key = np.where((a >= 0) & (b >= 0), a * (self.size + self.letters) + b, -1)
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            to = np.where(self.merge_keys[at] == key, self.merge_to[at], -1)
            weight = np.where(to >= 0, self.score[to], worst)
            best = weight.argmax(axis=1)
            index = np.arange(len(live))
            merges = to[index, best] >= 0
            done = live[~merges]
            good[done] = (size[done] == 2) & (span[done, 0] == first_len[done])
            row, col = live[merges], best[merges]
            # a merge over the border can never be undone
            before = np.where(np.arange(span.shape[1])[None, :] <= col[:, None], span[row], 0).sum(axis=1)
            over = before == first_len[row]
            rows[row, col] = to[index, best][merges]
            span[row, col] += span[row, col + 1]
            for array, fill in ((rows, -1), (span, 0)):
                moved = array[row]
                places = np.arange(moved.shape[1])[None, :]
                source = np.minimum(places + (places > col[:, None]), moved.shape[1] - 1)
                shifted = np.take_along_axis(moved, source, axis=1)
                shifted[:, -1] = fill
                array[row] = shifted
            size[row] -= 1
            live = row[~over]
        return good

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether step left -> right of the bigram acceptor is free."""
        wide = self.size + self.letters
        key = left * wide + right
        slot = (mix(key.view(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot_good[slot]
        lost = np.flatnonzero(self.slot_keys[slot] != key)
        if len(lost):
            out[lost] = self._steps(key[lost])
            self.slot_keys[slot[lost]] = key[lost]
            # of several keys of a slot, the one that stays brings its own value
            self.slot_good[slot[lost]] = out[lost]
            stays = self.slot_keys[slot[lost]] == key[lost]
            self.slot_good[slot[lost][stays]] = out[lost][stays]
        return out

    def _steps(self, key: np.ndarray) -> np.ndarray:
        wide = self.size + self.letters
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
        missing = self.pair_keys[at] != key if len(self.pair_keys) else np.ones(len(key), bool)
        if missing.any():
            new = np.unique(key[missing])
            a, b = new // wide, new % wide
            size_a, size_b = self.spelled_size[a], self.spelled_size[b]
            most = int((size_a + size_b).max())
            places = np.arange(most + 1)[None, :]
            in_a, in_b = places < size_a[:, None], (places >= size_a[:, None]) & (places < (size_a + size_b)[:, None])
            width = self.spelling.shape[1] - 1
            rows = np.where(in_a, self.spelling[a[:, None], np.minimum(places, width)], -1)
            rows = np.where(in_b, self.spelling[b[:, None], np.clip(places - size_a[:, None], 0, width)], rows)
            good = self._merged(rows, size_a)
            into = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_good = np.insert(self.pair_keys, into, new), np.insert(self.pair_good, into, good)
            at = np.searchsorted(self.pair_keys, key)
        return self.pair_good[at]

    def _arcs(self, letters: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Composition with the pieces: (start, length, symbol) of every piece in the stretches."""
        start, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        found = [(start, np.ones(len(start), np.int64), self.symbol_of_letter[letters])]
        length = 0
        while len(start):
            key = node * self.letters + letters[start + length]
            at = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            on = self.arc_keys[at] == key
            start, node = start[on], self.arc_to[at[on]]
            length += 1
            piece = self.final[node]
            if length > 1:
                whole = piece >= 0
                found.append((start[whole], np.full(int(whole.sum()), length), piece[whole]))
            more = left[start] > length
            start, node = start[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _paths(self, letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest path of each stretch: symbols and their number."""
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(size)), size)
        offset = np.arange(len(letters)) - bounds[owner]
        start, length, symbol = self._arcs(letters, size[owner] - offset)
        end = offset[start] + length
        order = np.argsort(end, kind="stable")
        start, length, symbol, end = start[order], length[order], symbol[order], end[order]
        cut = np.searchsorted(end, np.arange(1, int(size.max(initial=0)) + 2))
        base = bounds[:-1] + np.arange(len(size))  # states: one more than letters
        state = np.arange(len(letters)) + owner
        weight = np.full(len(letters) + len(size), np.inf)
        weight[base] = 0
        last, back = np.full(len(weight), -1), np.full(len(weight), -1)
        for step in range(len(cut) - 1):
            some = slice(cut[step], cut[step + 1])
            here, word = state[start[some]], symbol[some]
            cost = weight[here]
            if self.kind == UNIGRAM:
                cost = cost - self.score[word] + np.where(word >= self.size, 1e6, 0)
            else:
                reached = np.flatnonzero(np.isfinite(cost))
                inner = reached[last[here[reached]] >= 0]
                cost[inner] += np.where(self._joins(last[here[inner]], word[inner]), 0, np.inf)
            target = here + length[some]
            # least weight per target; of equal ones the longest last piece
            order = np.lexsort((-length[some], cost, target))
            first = order[np.concatenate([[True], np.diff(target[order]) != 0])] if len(order) else order
            first = first[np.isfinite(cost[first])]
            weight[target[first]], last[target[first]], back[target[first]] = cost[first], word[first], here[first]
        at = base + size
        paths, live = [], np.arange(len(size))
        while len(live):
            inner = at[live] > base[live]
            live = live[inner]
            if not len(live):
                break
            paths.append((live, last[at[live]]))
            at[live] = back[at[live]]
        if not paths:
            return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
        of, word = (np.concatenate(x) for x in zip(*reversed(paths), strict=True))
        order = np.argsort(of, kind="stable")
        return word[order], np.bincount(of, minlength=len(size))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a group of UTF-8 texts, one after the other, and the bounds of the texts."""
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        head = " " if self.prefix else ""
        joined = "".join([head + t if t else "" for t in texts])
        sizes = np.array([len(t) + len(head) if t else 0 for t in texts])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        codes = np.where(codes == 0x20, META, codes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not len(codes):
            return np.zeros(0, np.int64), bounds
        letters = self.letter_of[codes]
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~self.beside[letters[:-1], letters[1:]]
        cut[bounds] = True
        begin = np.flatnonzero(cut)
        rolling = RollingHash(mix(codes.astype(np.uint64)))
        names = rolling.slices(begin[:-1], begin[1:])
        different, where, which = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) + len(different) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, different), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != different) if len(self.known) else np.arange(len(different))
        if len(new):
            first, size = begin[:-1][where[new]], np.diff(begin)[where[new]]
            stops = np.concatenate([[0], np.cumsum(size)])
            flat = np.repeat(first - stops[:-1], size) + np.arange(stops[-1])
            word, count = self._paths(letters[flat], stops)
            ids, id_count = self._outputs(word, count, codes[flat], stops)
            into = np.searchsorted(self.known, different[new])
            self.known_first = np.insert(self.known_first, into, len(self.known_ids) + np.cumsum(id_count) - id_count)
            self.known_size = np.insert(self.known_size, into, id_count)
            self.known = np.insert(self.known, into, different[new])
            self.known_ids = np.concatenate([self.known_ids, ids.astype(np.int32)])
        place = np.searchsorted(self.known, different)[which]
        count, first = self.known_size[place].astype(np.int64), self.known_first[place]
        ends = np.cumsum(count)
        ids = self.known_ids[np.repeat(first - ends + count, count) + np.arange(ends[-1])]
        totals = np.concatenate([[0], ends])
        return ids, totals[np.searchsorted(begin, bounds)]

    def _outputs(self, word: np.ndarray, count: np.ndarray, codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols of each stretch; characters that are no piece become bytes (or the unknown piece)."""
        owner = np.repeat(np.arange(len(count)), count)
        odd = np.flatnonzero(word >= self.size)
        if not len(odd):
            return word, count
        spelled = self.spelled_size[word]
        place = np.cumsum(spelled) - spelled  # letters before, over all stretches
        pieces = [[i] for i in word.tolist()]
        for k in odd.tolist():
            raw = chr(int(codes[place[k]])).encode("utf-8", "replace")
            pieces[k] = self.byte_ids[list(raw)].tolist() if self.fallback else [self.unknown]
        sizes = np.array([len(p) for p in pieces])
        return np.array([i for p in pieces for i in p], np.int64), np.bincount(owner, weights=sizes, minlength=len(count)).astype(np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of a group of id sequences, and their bounds."""
        size = self.out_size[ids]
        ends = np.cumsum(size)
        data = self.out_bytes[np.repeat(self.out_first[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[bounds]
        if not self.prefix:
            return data, stops
        heads = stops[:-1][np.diff(stops) > 0]
        heads = heads[data[heads] == 0x20]
        gone = np.zeros(len(data) + 1, np.int64)
        gone[heads + 1] = 1
        return np.delete(data, heads), stops - np.cumsum(gone)[stops]


@functools.lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _encode_task(shared):
    names = ["doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(shared.value)
        meta = chr(META).encode()
        for batch in batches:
            for part, data, offsets in text_groups(batch):
                ids, bounds = transducer.encode(data, offsets)
                out, stops = transducer.decode(ids, bounds)
                raw, back = data.tobytes(), out.tobytes()
                digests, same = [], []
                for a, b, x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                    digests.append(hashlib.sha256(back[x:y]).hexdigest())
                    same.append(back[x:y] == raw[a:b].replace(meta, b" "))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                     pa.array(np.diff(bounds)), pa.array(digests), pa.array(same)], names=names)

    return run


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids, n_tokens, decoded_sha256, round_trip``.

    ``round_trip`` says whether decoding the ids gives back the text (in which the meta symbol stands for a space).  Null
    and empty texts have no ids.  Repeated rows each get a row.  Nothing is shuffled; the model (fixed size) is broadcast.
    Empty tables give an empty result; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"
    return keyed(docs, id_col, text_col).select("doc_id", "text").mapInArrow(_encode_task(shared), schema)
