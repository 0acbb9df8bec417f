"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is cut into units (spaces with the word after them; tabs and line feeds alone), which no piece of the
model spans.  Distinct units are encoded once, in batches of equal length that advance together: hashes of all
substrings up to the longest piece probe the sorted piece keys, which gives every substring's id.  Then, for
each end position, vectorised maxima over the piece lengths store scores and backpointers.

* A unigram model weighs a piece by its score; ties go to the longer piece, as in the library.  (The library sums over
  the whole text in single precision, so between segmentations of one unit with equal sums its rounding may choose otherwise.)
* A BPE model does not ask for the best sum of scores.  But its segmentation is the one sequence of pieces in which every two
  neighbours withstand the merges: text a + b, merged by itself, ends as the pieces a and b.  So a transition from a to b
  weighs 0 if the pair stands and minus infinity if not, and the path with a finite sum is the library's.  Whether a
  pair stands follows from undoing the merges of both pieces along their common border, latest first: some merge
  across the border, due before the one undone, breaks it.  Results are kept in a table of fixed size.  This needs merges
  in order of rank (a piece's parts have better scores than the piece, and no other piece its score); units that hold a
  piece out of order (runs of spaces, in common models), units longer than LONG characters, and models whose pieces hold
  characters that are no pieces, are merged step by step, with the same ids.

Characters missing from the model become bytes (byte fallback) or the unknown id, once for a run of them.  Models with
a character map or other rules of normalisation have their texts normalised by the library; the rest is the same.

Defined results: null and empty texts have no ids and decode to an empty text; ids out of range raise; texts that hold
the space mark U+2581 itself, and models with user-defined pieces or pieces across spaces, are encoded by the library;
repeated rows are encoded alike; other columns pass through; a column with the name of the added one goes on as <name>_in.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caduspark.llm import shared, textnum
from caduspark.llm.bpe_ids import PIECE, Encoder

MARK = "▁"
LONG = 512
_PARTED = np.zeros(256, bool)
_PARTED[[0x20, 0x09, 0x0A]] = True
_BASE = 0xA24BAED4963EE407
_NONE = np.float32(-np.inf)


_BITS = 20  # of a hash that choose a bucket of piece keys
_PAIR_BITS = 21  # of a hash that choose a slot of the table of pairs
_NEVER = np.int64(1 << 40)


class Pieces:
    """Pieces of a model as sorted keys, and the ways to segment a batch of equal-length units."""

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], bytes_at: list[int] | None, unknown: int, unigram: bool):
        self.unigram, self.bytes_at, self.unknown = unigram, bytes_at, unknown
        self.ids = {p: i for i, p in enumerate(pieces) if usable[i]}
        self.scores = np.array(scores, np.float32)
        self.longest = max((len(p) for p in self.ids), default=1)
        self.raw, self.size = np.zeros(len(pieces), np.uint64), np.zeros(len(pieces), np.int64)
        self.by_length: dict[int, list[int]] = {}
        for p, i in self.ids.items():
            self.by_length.setdefault(len(p), []).append(i)
        for length, some in self.by_length.items():
            self.raw[some] = self._hashes(np.array([[ord(c) for c in pieces[i]] for i in some], np.uint64))[:, -1]
            self.size[some] = length
        self._sort(np.array(sorted(self.ids.values()), np.int64))
        low = min((scores[i] for i in self.ids.values()), default=0.0)
        self.missing = np.float32(low - 10)
        self.chained = not unigram and self._undo(pieces)

    def _sort(self, ids: np.ndarray) -> None:
        keys = textnum.mix(self.raw[ids] + (self.size[ids] << 40).astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order].astype(np.int32)
        self.bucket = np.searchsorted((self.keys >> np.uint64(64 - _BITS)).astype(np.int64), np.arange((1 << _BITS) + 1)).astype(np.int32)

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; -1 where there is no such piece."""
        out = np.full(len(hashed), -1, np.int32)
        slot = (hashed >> np.uint64(64 - _BITS)).astype(np.int64)
        at, end = self.bucket[slot], self.bucket[slot + 1]
        live = np.flatnonzero(at < end)
        at, end, wanted = at[live], end[live], hashed[live]
        while len(live):
            hit = self.keys[at] == wanted
            out[live[hit]] = self.key_ids[at[hit]]
            more = ~hit & (at + 1 < end)
            live, at, end, wanted = live[more], at[more] + 1, end[more], wanted[more]
        return out

    def _undo(self, pieces: list[str]) -> bool:
        """Rank and two parts of the merge that makes each piece; whether pairs tell, but for units with a loose piece in them.

        Loose pieces are not merged in order of rank: they share a score, or a part of theirs has a worse one.
        """
        order = np.lexsort((np.arange(len(pieces)), -self.scores))
        self.rank = np.full(len(pieces), -1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.full(len(pieces), -1, np.int64), np.full(len(pieces), -1, np.int64)
        made = [np.array(self.by_length.get(1, []), np.int64)]
        self.rank[made[0]] = -1
        for length, some in self.by_length.items():
            if length == 1:
                continue
            some = np.array(some)
            table = self.table(np.array([[ord(c) for c in pieces[i]] for i in some], np.uint32))
            ends, last = self._merge(table)
            whole = np.flatnonzero(ends[:, 0] == length)  # others never come out of merges
            made.append(some[whole])
            self.left[some[whole]] = table[whole, 0, last[whole] - 1]
            self.right[some[whole]] = table[whole, last[whole], length - last[whole] - 1]
        made = np.concatenate(made)
        grown = made[self.size[made] > 1]
        if (self.left[grown] < 0).any() or (self.right[grown] < 0).any() or set("".join(self.ids)) - {p for p in self.ids if len(p) == 1}:
            return False
        _, which, times = np.unique(self.scores[grown], return_inverse=True, return_counts=True)
        late = np.maximum(self.rank[self.left[grown]], self.rank[self.right[grown]]) >= self.rank[grown]
        self.loose = np.zeros(len(pieces) + 1, bool)  # the last place stands for no piece
        self.loose[grown[late | (times[which] > 1)]] = True
        self._sort(made)
        self.shift = textnum.powers(_BASE, self.longest + 1)
        self.pair_keys, self.pair_stands = np.full(1 << _PAIR_BITS, -1, np.int64), np.zeros(1 << _PAIR_BITS, bool)
        return True

    def _stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of the text of pieces a and b leave both standing."""
        out = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), _NEVER)
        while len(live):
            across = self._find(textnum.mix(self.raw[a] + self.raw[b] * self.shift[self.size[a]] + ((self.size[a] + self.size[b]) << 40).astype(np.uint64)))
            broken = (across >= 0) & (2 * self.rank[across] < limit)
            out[live[broken]] = False
            go = ~broken & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            live, a, b = live[go], a[go], b[go]
            left = self.rank[a] > self.rank[b]  # the later merge is undone; of equal ones, the right
            limit = np.where(left, 2 * self.rank[a], 2 * self.rank[b] + 1)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return out

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand after piece a; -1 is the start, or a character that is no piece."""
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        pair = a[live].astype(np.int64) * len(self.size) + b[live]
        slot = (textnum.mix(pair.view(np.uint64)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        known = self.pair_keys[slot] == pair
        out[live[known]] = self.pair_stands[slot[known]]
        if not known.all():
            pair, first, inverse = np.unique(pair[~known], return_index=True, return_inverse=True)
            slot = slot[~known][first]
            stands = self._stands(pair // len(self.size), pair % len(self.size))
            out[live[~known]] = stands[inverse]
            self.pair_keys[slot] = pair
            won = self.pair_keys[slot] == pair
            self.pair_stands[slot[won]] = stands[won]
        return out

    @staticmethod
    def _hashes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        np.cumsum(textnum.mix(codes + np.uint64(1)) * textnum.powers(_BASE, codes.shape[1])[None], axis=1, out=out[:, 1:])
        return out

    @staticmethod
    def _substring(prefix: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        inverse = textnum.powers(_BASE, prefix.shape[1], True)[start]
        return textnum.mix((prefix[:, start + length] - prefix[:, start]) * inverse[None] + np.uint64(length << 40))

    def table(self, codes: np.ndarray) -> np.ndarray:
        """Ids of all substrings, [unit, start, length - 1]; -1 where there is no such piece."""
        n, size = codes.shape
        prefix = self._hashes(codes.astype(np.uint64))
        out = np.full((n, size, min(size, self.longest)), -1, np.int32)
        for length in range(1, out.shape[2] + 1):
            start = np.arange(size - length + 1)
            out[:, start, length - 1] = self._find(self._substring(prefix, start, length).ravel()).reshape(n, -1)
        return out

    def segment(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table, end of the segment that starts at each place or 0) of units of one length."""
        table = self.table(codes)
        if self.unigram:
            return table, self._viterbi(table)
        if not self.chained:
            return table, self._merge(table)[0]
        loose = self.loose[table].any((1, 2))
        if not loose.any():
            return table, self._viterbi(table)
        ends = np.zeros(codes.shape, np.int64)
        ends[loose], ends[~loose] = self._merge(table[loose])[0], self._viterbi(table[~loose])
        return table, ends

    def _viterbi(self, table: np.ndarray) -> np.ndarray:
        n, size, longest = table.shape
        back = np.zeros((n, size + 1), np.int64)
        best = np.zeros((n, size + 1), np.float32)
        last = np.full((n, size + 1), -1, np.int32)  # the piece that ends at each place
        rows = np.arange(n)
        for end in range(1, size + 1):
            lengths = np.arange(min(end, longest), 0, -1)  # of equal scores the longest piece wins
            ids = table[:, end - lengths, lengths - 1]
            if self.unigram:
                score = np.where(ids >= 0, self.scores[ids], _NONE)
                score[:, -1] = np.where(ids[:, -1] >= 0, score[:, -1], self.missing)
            else:
                some, which = np.nonzero((ids >= 0) | (lengths == 1))
                score = np.full(ids.shape, _NONE, np.float32)
                score[some, which] = np.where(self._may_follow(last[some, end - lengths[which]], ids[some, which]), np.float32(0), _NONE)
            score = score + best[:, end - lengths]
            won = score.argmax(1)
            best[:, end], back[:, end], last[:, end] = score[rows, won], lengths[won], ids[rows, won]
        ends = np.zeros((n, size), np.int64)
        at = np.full(n, size)
        while (at > 0).any():
            rows = np.flatnonzero(at > 0)
            start = at[rows] - back[rows, at[rows]]
            ends[rows, start] = at[rows]
            at[rows] = start
        return ends

    def _merge(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends as of segment, place of each unit's last merge): in every step the leftmost pair of best score merges."""
        n, size, longest = table.shape
        out, last = np.tile(np.arange(1, size + 1), (n, 1)), np.zeros(n, np.int64)
        flat = np.where(table >= 0, self.scores[table], _NONE).reshape(-1)
        place, rows, ends = np.arange(size), np.arange(n), out.copy()
        while len(rows) and size > 1:
            padded = np.concatenate([ends, np.zeros((len(rows), 1), ends.dtype)], 1)
            middle = np.where(ends > 0, ends, size)
            after = padded.reshape(-1)[middle + (np.arange(len(rows)) * (size + 1))[:, None]]
            length = after - place
            ok = (length > 0) & (length <= longest) & (ends > 0)
            score = np.where(ok, flat[np.where(ok, (rows[:, None] * size + place) * longest + length - 1, 0)], _NONE)
            best = score.argmax(1)
            some = np.arange(len(rows))
            live = score[some, best] > _NONE
            if not live.all():
                out[rows[~live]] = ends[~live]
                rows, best, ends = rows[live], best[live], ends[live]
                some = some[: len(rows)]
            inner = ends[some, best]
            ends[some, best] = ends[some, inner]
            ends[some, inner] = 0
            last[rows] = inner
        return out, last

    def heap(self, unit: str) -> list[str]:
        """BPE merges of one long unit."""
        parts: list[str | None] = list(unit)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0:
                piece = parts[i] + parts[j]
                k = self.ids.get(piece)
                if k is not None:
                    heapq.heappush(queue, (-float(self.scores[k]), i, j, piece))

        for i in range(len(parts)):
            push(i)
        while queue:
            _, i, j, piece = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [p for p in parts if p is not None]

    def spell(self, piece: str) -> list[int]:
        """Ids of a piece or, character by character, of what the model lacks."""
        k = self.ids.get(piece)
        if k is not None:
            return [k]
        if self.bytes_at is not None:
            return [self.bytes_at[b] for b in piece.encode()]
        return [self.unknown]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, ids of each unit)."""
        return self.encode_codes(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32), np.fromiter(map(len, units), np.int64, len(units)))

    def encode_codes(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of units given as code points one after another."""
        begin = np.cumsum(lengths) - lengths
        sizes = np.zeros(len(lengths), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # (units, their ids one after another)
        order = np.argsort(lengths, kind="stable")
        for which in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            length = int(lengths[which[0]]) if len(which) else 0
            if length > LONG and not self.unigram:
                for i in which:
                    unit = codes[begin[i] : begin[i] + length].tobytes().decode("utf-32-le")
                    ids = np.array([k for p in self.heap(unit) for k in self.spell(p)], np.uint32)
                    sizes[i] = len(ids)
                    done.append((np.array([i]), ids))
                continue
            step = max(1, 60_000 // max(1, length))
            for at in range(0, len(which) if length else 0, step):
                some = which[at : at + step]
                block = codes[begin[some][:, None] + np.arange(length)]
                table, ends = self.segment(block)
                row, start = np.nonzero(ends)
                ids = table[row, start, ends[row, start] - start - 1]
                lack = np.flatnonzero(ids < 0)  # single characters
                if len(lack):
                    spelt = [self.spell(chr(c)) for c in block[row[lack], start[lack]].tolist()]
                    times = np.ones(len(ids), np.int64)
                    times[lack] = [len(x) for x in spelt]
                    first = np.cumsum(times) - times
                    ids, row = np.repeat(ids, times), np.repeat(row, times)
                    for f, x in zip(first[lack].tolist(), spelt):
                        ids[f : f + len(x)] = x
                sizes[some] = np.bincount(row, minlength=len(some))
                done.append((some, ids.astype(np.uint32)))
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        for some, ids in done:
            own = sizes[some]
            out[np.repeat(starts[some] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return out, sizes


class Codec(Encoder):
    """A SentencePiece model: ids of texts, and texts of ids."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = [p.type for p in model.pieces]
        names = [p.piece for p in model.pieces]
        spec, normal = model.trainer_spec, model.normalizer_spec
        if spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        parted = all(MARK not in p.lstrip(MARK) and not any(c in p for c in "\t\n") for p, k in zip(names, kinds) if k in (1, 4))
        self.plain = not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.add_dummy_prefix and normal.escape_whitespaces
        self.own = parted and normal.escape_whitespaces and not any(k in (4, 5) for k in kinds)
        table = None
        if spec.byte_fallback:
            table = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pieces = Pieces(names, [p.score for p in model.pieces], [k == 1 for k in kinds], table, self.library.unk_id(), spec.model_type == 1)
        raw = []
        for name, kind in zip(names, kinds):
            raw.append(bytes([int(name[3:5], 16)]) if kind == 6 else " ⁇ ".encode() if kind == 2 else b"" if kind == 3 else name.replace(MARK, " ").encode())
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._clear()

    def _ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(units)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        try:
            codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            first = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[np.concatenate([[0], np.cumsum(lengths)])]
            lengths = np.diff(first)
        except UnicodeDecodeError:
            texts = [u.decode("utf-8", "replace") for u in units]
            codes, lengths = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts])
        ids, sizes = self.pieces.encode_codes(np.where(codes == 0x20, np.uint32(ord(MARK)), codes), lengths)
        if self.pieces.bytes_at is None:  # a run of unknown characters is one unknown id
            of = np.repeat(np.arange(len(sizes)), sizes)
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.pieces.unknown) & (ids[:-1] == self.pieces.unknown) & (of[1:] == of[:-1])
            ids, sizes = ids[~again], np.bincount(of[~again], minlength=len(sizes))
        return ids, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if self.own and not self.plain:
            texts = [self.library.normalize(raw[a:b].decode("utf-8", "replace")).replace(MARK, " ").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return self._encode(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        if not self.own or MARK.encode() in raw:
            pairs = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            odd = [not self.own or MARK.encode() in raw[a:b] for a, b in pairs]
            rest = [raw[a:b] for (a, b), o in zip(pairs, odd) if not o]
            flat, sizes = self.encode(np.frombuffer(b"".join(rest), np.uint8), np.cumsum([0, *map(len, rest)])) if rest else (None, np.zeros(0, np.int64))
            plain = iter(np.split(flat, np.cumsum(sizes)[:-1]) if rest else [])
            got = [np.array(self.library.encode(raw[a:b].decode("utf-8", "replace")), np.uint32) if o else next(plain) for (a, b), o in zip(pairs, odd)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(g) for g in got], np.int64)
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], 0x20)  # the dummy prefix
        return self._encode(data, offsets + np.concatenate([[0], np.cumsum(some)]))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts."""
        some = np.diff(offsets) > 0
        words = textnum.Words(data, offsets, space=_PARTED)
        control = np.flatnonzero(_PARTED[data] & (data != 0x20))

        def since(at: np.ndarray, text: np.ndarray) -> np.ndarray:
            """End of the last word, control character or text before each place."""
            w = np.concatenate([[0], words.end])[np.searchsorted(words.end, at, "right")]
            c = np.concatenate([[0], control + 1])[np.searchsorted(control, at)]
            return np.maximum(np.maximum(w, c), offsets[text])

        text = np.repeat(np.arange(len(some)), np.diff(words.first))
        stops = np.concatenate([control, offsets[1:][some]])
        stop_text = np.concatenate([np.searchsorted(offsets, control, "right") - 1, np.flatnonzero(some)])
        blank = since(stops, stop_text)
        left = blank < stops
        starts = np.concatenate([since(words.start, text), control, blank[left]])
        ends = np.concatenate([words.end, control + 1, stops[left]])
        order = np.argsort(starts, kind="stable")
        return self._gather(data.tobytes(), starts[order], ends[order], words, offsets)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids that stand one after another; invalid bytes become U+FFFD."""
        if not self.plain:
            return [self.library.decode(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
        size = self.raw_size[ids]
        total = np.cumsum(size)
        data = self.raw[np.repeat(self.raw_start[ids] - (total - size), size) + np.arange(total[-1] if len(total) else 0)].tobytes()
        ends = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)  # without the dummy prefix
        return out


@lru_cache(4)
def codec(path: str) -> Codec:
    """One codec for each Python worker and file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with the ids of every whole text."""
    shared.tune(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        found = [codec(path).encode(data, offsets) for _, _, data, offsets in textnum.pieces(column, PIECE)]
        if not found:
            return pa.array([], pa.list_(pa.int32()))
        return textnum.lists(np.concatenate([f[0] for f in found]).astype(np.int32), np.concatenate([f[1] for f in found]), pa.int32())

    return shared.with_added(docs, name, run(F.col(f"`{text}`")))


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """docs with the text of every list of ids."""
    shared.tune(docs.sparkSession)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        counts = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        return pa.array(codec(path).decode(np.asarray(column.flatten()).astype(np.int64), counts), pa.string())

    return shared.with_added(docs, name, run(F.col(f"`{ids}`")))


def digest(docs: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """docs with the unsigned CRC-32 of the ids as little-endian unsigned 32-bit numbers."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(np.asarray(x.values).astype("<u4").tobytes()) if x.is_valid else 0 for x in column], pa.int64())

    return shared.with_added(docs, name, run(F.col(f"`{ids}`")))
