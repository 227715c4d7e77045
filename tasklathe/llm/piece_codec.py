"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Method.  A text's symbols are its characters.  An agenda (a heap ordered by
piece score, then by position) holds every adjacent pair of symbols whose
concatenation is a piece; the best pair is merged, pairs that a merge has made
stale are skipped, and the new neighbours are entered.  Symbols that end up
without a piece of their own become their UTF-8 bytes' pieces, or the unknown
piece where the vocabulary has no bytes.

A merge's result is always a piece, so nothing merges across two adjacent
characters that no piece holds side by side.  Where no piece has a space mark
after another character, texts are therefore cut before space marks, at
characters that no longer piece holds (such as line ends) and between letters
and others (letters that a piece holds beside another kind count as others).  Each distinct cut is encoded once; the
result is exactly that of the whole text's agenda.

Short cuts that are new go through the agenda together, as rows of a matrix: in
each round every row merges its best pair, leftmost among equals, which is the
order in which its own agenda would pop them.  Longer ones, and cuts with
characters that are no pieces, have a heap of their own.

Every Arrow batch is checked against the sentencepiece library: a text whose
ids or decoded text differ from the library's raises an error.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordbuf

SPACE = "▁"
#: Cuts that a worker remembers, about.
REMEMBERED = 500_000
_SLICE = 1 << 20


class _Known(dict):
    """Ids of the cuts met lately; a new one is encoded when it is first asked for.

    Two generations: what was met in the one before is taken over, and the older
    one is dropped when the younger is full.
    """

    def __init__(self, encode, before: dict | None = None) -> None:
        self.encode, self.before = encode, before or {}

    def __missing__(self, cut: str) -> bytes:
        ids = self.before.get(cut)
        if ids is None:
            ids = self.encode(cut)
        self[cut] = ids
        return ids

    def new(self, cuts: set[str]) -> set[str]:
        """Those that neither generation holds; what the older one holds is taken over."""
        cuts = cuts.difference(self)
        if self.before:
            met = cuts.intersection(self.before)
            self.update((c, self.before[c]) for c in met)
            cuts -= met
        return cuts

    def aged(self) -> _Known:
        self.before = {}
        return _Known(self.encode, self)


#: Cuts of at most so many characters go through the agenda together.
TOGETHER = 32


class _Pairs:
    """The agenda of many short cuts at once: ids of single characters, and rank and id of every pair that makes a piece."""

    def __init__(self, ids: dict[str, int], rank: dict[str, float]) -> None:
        self.single = np.full(0x110000, -1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        made = [(ids[p[:k]] << 32 | ids[p[k:]], rank[p], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        keys = np.array([m[0] for m in made], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.append(np.array([m[1] for m in made], dtype=np.float64)[order], np.inf)
        self.merged = np.append(np.array([m[2] for m in made], dtype=np.int32)[order], -1)
        self.bits = max(10, (8 * max(1, len(keys))).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        slot = self._slot(self.keys)
        self.slots[slot] = np.arange(len(keys))
        self.shared = np.bincount(slot, minlength=1 << self.bits) > 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair; the last place (rank infinity) for pairs that make no piece."""
        none = len(self.keys)
        if not none:
            return np.zeros(left.shape, dtype=np.int64)
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys.ravel()).reshape(keys.shape)
        place = self.slots[slot]
        hit = self.keys[place] == keys
        again = ~hit & self.shared[slot]
        if again.any():
            found = np.minimum(np.searchsorted(self.keys, keys[again]), none - 1)
            place[again], hit[again] = found, self.keys[found] == keys[again]
        return np.where(hit, place, none)

    def merge(self, symbols: np.ndarray) -> list[bytes]:
        """Packed final ids of rows of equally many symbols: in every row the pair of best rank, leftmost among equals, merges until none is left."""
        out: list[bytes] = [b""] * len(symbols)
        rows = np.arange(len(symbols))
        while len(rows):
            width = symbols.shape[1]
            if width == 1:
                best, able = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=bool)
            else:
                place = self.find(symbols[:, :-1], symbols[:, 1:])
                rank = self.rank[place]
                best = rank.argmin(axis=1)
                able = np.isfinite(rank[np.arange(len(rows)), best])
            raw = symbols[~able].astype("<u4").tobytes()
            for k, i in enumerate(rows[~able].tolist()):
                out[i] = raw[4 * width * k : 4 * width * (k + 1)]
            if not able.any():
                break
            rows, symbols, best, place = rows[able], symbols[able], best[able], place[able]
            at = np.arange(len(rows))
            symbols[at, best] = self.merged[place[at, best]]
            keep = np.arange(width - 1)[None, :]
            symbols = np.take_along_axis(symbols, keep + (keep > best[:, None]), axis=1)
        return out

    def encode(self, cuts: list[str]) -> dict[str, bytes]:
        """Packed ids of those cuts that are short and made of characters that are pieces."""
        lengths = np.array(list(map(len, cuts)), dtype=np.int64)
        points = np.frombuffer("".join(cuts).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.single[points]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        whole = np.minimum.reduceat(symbols, starts[:-1]) >= 0 if len(cuts) else np.zeros(0, dtype=bool)
        out: dict[str, bytes] = {}
        for n in np.unique(lengths[whole & (lengths <= TOGETHER)]).tolist():
            some = np.flatnonzero(whole & (lengths == n))
            done = self.merge(symbols[starts[some][:, None] + np.arange(n)])
            out.update(zip([cuts[i] for i in some.tolist()], done, strict=True))
        return out


class PieceCodec:
    """Encoder and decoder of one serialised model."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(self.library.is_byte(i) for i in self.bytes)
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        packed = lambda i: i.to_bytes(4, "little")
        self.code = {p: packed(i) for p, i in self.ids.items()}
        self.byte_code = [packed(i) for i in self.bytes]
        self.unknown_code, self.marks = packed(self.unknown), (packed(self.begin), packed(self.end))
        self.control = {i for i in range(size) if self.library.is_control(i)}
        self.surface = [self._surface(i) for i in range(size)]
        longer = {c for p in self.ids if len(p) > 1 for c in p}
        lone = re.escape("".join(c for c in "\n\r\t" if c not in longer))
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        other = re.escape("".join(sorted(self._letters_beside_others())))
        groups = [rf"[^\W\d_{other}]+", rf"(?:[\W\d_{other}](?<![{SPACE}{lone}]))+"]
        cut = "|".join([f"[{lone}]"] * bool(lone) + [f"{SPACE}*{g}" for g in groups] + [f"{SPACE}+"])
        self.cuts = (lambda s: [s]) if inner else re.compile(cut).findall
        self.known = _Known(self._cut_ids)
        self.pairs = _Pairs(self.ids, self.rank)

    def _letters_beside_others(self) -> set[str]:
        """Letters that some piece holds next to another kind of character (a space mark apart), and so on from those."""
        kind = {c: bool(re.fullmatch(r"[^\W\d_]", c)) for p in self.ids for c in p}
        pairs = {(x, y) for p in self.ids for x, y in zip(p, p[1:], strict=False) if x != SPACE and y != SPACE}
        found: set[str] = set()
        while new := {c for x, y in pairs if kind[x] != kind[y] for c in (x, y) if kind[c]}:
            found |= new
            kind |= dict.fromkeys(new, False)
        return found

    def _surface(self, i: int) -> bytes:
        if i in self.control:
            return b""
        if self.library.is_unknown(i):
            return " ⁇ ".encode()
        if self.library.is_byte(i):
            return bytes([int(self.pieces[i][1:-1], 16)])
        return self.pieces[i].replace(SPACE, " ").encode()

    def merge(self, symbols: list[str]) -> list[str]:
        """Agenda merging of adjacent symbols, best score first, then leftmost."""
        rank, count, pop, push = self.rank.get, len(symbols), heapq.heappop, heapq.heappush
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        agenda = [(score, i, i + 1, 2) for i in range(count - 1) if (score := rank(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, length = pop(agenda)
            one, two = symbols[left], symbols[right]
            if not one or not two or len(one) + len(two) != length:  # stale: either end has merged meanwhile
                continue
            symbols[left] = one = one + two
            symbols[right] = ""
            after[left] = nearest = after[right]
            if nearest >= 0:
                before[nearest] = left
                if (score := rank(one + symbols[nearest])) is not None:
                    push(agenda, (score, left, nearest, length + len(symbols[nearest])))
            if (nearest := before[left]) >= 0 and (score := rank(symbols[nearest] + one)) is not None:
                push(agenda, (score, nearest, left, length + len(symbols[nearest])))
        return [s for s in symbols if s]

    def _cut_ids(self, cut: str) -> bytes:
        code, out = self.code, []
        for symbol in self.merge(list(cut)):
            if (packed := code.get(symbol)) is not None:
                out.append(packed)
            elif self.has_bytes:
                out += [self.byte_code[b] for b in symbol.encode()]
            elif not out or out[-1] != self.unknown_code:
                out.append(self.unknown_code)
        return b"".join(out)

    def encode(self, text: str, marks: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end ids if ``marks``."""
        known, body = self.known, b""
        if text:
            if len(known) > REMEMBERED // 2:
                known = self.known = known.aged()
            body = b"".join(map(known.__getitem__, self.cuts(SPACE + text.replace(" ", SPACE))))
        if not marks:
            return body
        return self.marks[0] + body + self.marks[1]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of every text; cuts that are new go through the agenda together."""
        if len(self.known) > REMEMBERED // 2:
            self.known = self.known.aged()
        split = [self.cuts(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.known.update(self.pairs.encode(list(self.known.new(set().union(*split)))))
        known = self.known.__getitem__
        return [self.marks[0] + b"".join(map(known, cuts)) + self.marks[1] for cuts in split]

    def decode(self, ids: bytes) -> str:
        """Text of such ids: control ids vanish, byte ids join into characters, the first space mark goes."""
        surface = self.surface
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        raw = b"".join([surface[i] for i in numbers])
        first = next((i for i in numbers if i not in self.control), None)
        if first is not None and self.pieces[first].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", errors="replace")

    def check(self, texts: list[str], ids: list[bytes], decoded: list[str]) -> None:
        """Raise where the library gives other ids or another decoded text.

        Ids are compared for every text.  A text that comes back as it went in
        needs no second decoding; the library decodes the others.
        """
        theirs = self.library.encode(texts, out_type=int, add_bos=True, add_eos=True, num_threads=1)
        for text, own, other, mine in zip(texts, ids, theirs, decoded, strict=True):
            if own != np.array(other, dtype="<u4").tobytes() or (mine != text and mine != self.library.decode(other)):
                raise ValueError(f"ids or decoded text differ from the sentencepiece library for {text[:80]!r}")


def _codec(model: bytes) -> PieceCodec:
    """The worker's codec of a model, kept with its cuts from task to task until the worker serves another operator."""
    codecs = wordbuf.kept("piece_codec")
    if model not in codecs:
        codecs.clear()
        codecs[model] = PieceCodec(model)
    return codecs[model]


def _run(model: bytes, text_col: str, checked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        gc.disable()  # lists of ids by the million, none of them in cycles
        try:
            for batch in batches:
                for a, b, _, _ in wordbuf.pieces(batch.column(text_col), _SLICE):
                    part = batch.column(text_col).slice(a, b - a).fill_null("").to_pylist()
                    ids = codec.encode_all(part)
                    decoded = [codec.decode(i) for i in ids]
                    if checked:
                        codec.check(part, ids, decoded)
                    kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns)]
                    counts = pa.array([len(i) // 4 for i in ids], type=pa.int64())
                    yield pa.RecordBatch.from_arrays([*kept, counts, pa.array(ids, type=pa.binary()), pa.array(decoded, type=pa.string())], names=[*batch.schema.names, "n_tokens", "token_ids", "decoded"])
        finally:
            gc.enable()
            wordbuf.give_back()

    return run


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", checked: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` (long), ``token_ids`` (binary, little-endian 32-bit) and ``decoded`` (string).

    With ``checked``, one text whose ids or decoding differ from the library's ends
    the whole job with an error that shows its beginning.

    model_path is a file of the driver; its bytes travel with the tasks (they
    are a fixed half megabyte).  Whole texts are encoded with begin and end ids
    and without sampling.  Null texts read as empty and give the two marks and
    an empty decoded text.  Columns of docs that bear an output's name are
    replaced.  Order, repeats and other columns stay as they are; an empty table
    stays empty.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    outputs = ("n_tokens", "token_ids", "decoded")
    docs = docs.select(*[c for c in docs.columns if c not in outputs])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_run(model, text_col, checked), f"{kept}, n_tokens long, token_ids binary, decoded string")
