"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's text is cut before each run of spaces, which no piece crosses; each distinct word is encoded once. All words are one flat
array of symbols. A round finds in each word the least rank among its adjacent pairs (the better score has the lesser rank), merges
all its occurrences from the left at once, and compacts the array; words without a pair leave. Where a merge uncovers a rank that is
not above the one just merged in several places, the order of merges matters: those words, and very long ones,
are merged one pair at a time with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracewell.llm.text import bytes_of, once, pieces, plain, spans

_NONE = np.iinfo(np.int32).max
#: Words of more symbols are merged with a heap.
LONG_WORD = 256


class Model:
    """Lookup tables of one model file (BPE with byte fallback, a dummy prefix and no other normalisation)."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = own
        size = own.get_piece_size()
        names = [own.id_to_piece(i) for i in range(size)]
        self.size, self.bos, self.eos = size, own.bos_id(), own.eos_id()
        byte_ids = [i for i in range(size) if own.is_byte(i)]
        self.byte_id = np.zeros(256, np.int64)
        for i in byte_ids:
            self.byte_id[int(names[i][3:-1], 16)] = i
        plain_ids = [i for i in range(size) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i))]
        at = {names[i]: i for i in plain_ids}
        if any("▁" in x.lstrip("▁") for x in at):
            raise ValueError("a piece crosses words")
        # a character that is no piece is the symbol size + its code point
        self.symbol = np.arange(0x110000, dtype=np.int64) + size
        for name, i in at.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        scores = np.array([own.get_score(i) for i in range(size)])
        rank_of = np.unique(-scores, return_inverse=True)[1]
        of = lambda x: at.get(x, int(self.symbol[ord(x)]) if len(x) == 1 else None)
        found = [(of(name[:k]), of(name[k:]), i) for name, i in at.items() for k in range(1, len(name))]
        table = np.array([x for x in found if None not in x], np.int64).reshape(-1, 3)
        key = (table[:, 0] << 24) | table[:, 1]
        order = np.argsort(key)
        self.keys = np.append(key[order], np.iinfo(np.int64).max)
        self.made = np.append(table[order, 2], 0)
        self.ranks = np.append(rank_of[self.made[:-1]], _NONE).astype(np.int32)
        shown = [bytes([int(names[i][3:-1], 16)]) if own.is_byte(i) else b"" if own.is_control(i) else names[i].replace("▁", " ").encode() for i in range(size)]
        if own.unk_id() >= 0:
            shown[own.unk_id()] = " ⁇ ".encode()
        self.shown, self.shown_at = np.frombuffer(b"".join(shown), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in shown]))).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each adjacent pair; rank _NONE where they make no piece."""
        key = (left << 24) | right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE).astype(np.int32), self.made[at]

    def in_order(self, symbols: list[int]) -> list[int]:
        """One merge at a time: the best pair, the leftmost of equals."""
        n = len(symbols)
        symbols, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, made = self.pair(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), made.tolist())) if r != _NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0:
                key = (symbols[i] << 24) | symbols[right[i]]
                at = int(np.searchsorted(self.keys, key))
                if self.keys[at] == key:
                    heapq.heappush(heap, (int(self.ranks[at]), i, symbols[i], symbols[right[i]], int(self.made[at])))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j], right[i] = m, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of each word once no pair remains, flat, and how many each word has."""
        done: dict[int, np.ndarray] = {}
        begin = np.cumsum(lengths) - lengths
        first_symbols, first_begin, first_lengths = symbols, begin, lengths
        exact = set(np.flatnonzero(lengths > LONG_WORD).tolist())
        word = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD))
        symbols, lengths = symbols[spans(begin[word], lengths[word])], lengths[word]
        out_word, out_symbol = [], []
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(word)), lengths)
        rank = np.full(len(symbols), _NONE, np.int32)
        made = np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else owner
        rank[inner], made[inner] = self.pair(symbols[inner], symbols[inner + 1])
        last, several = np.full(len(word), -1, np.int32), np.zeros(len(word), bool)
        while len(word):
            least = np.minimum.reduceat(rank, starts)
            unsure = several & (least <= last)
            if unsure.any():
                exact.update(word[unsure].tolist())
            over = (least == _NONE) | unsure
            if over.any():
                gone = over[owner]
                ends = gone & ~unsure[owner]
                out_word.append(word[owner[ends]])
                out_symbol.append(symbols[ends])
                stay = ~gone
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                word, least, lengths = word[~over], least[~over], lengths[~over]
                owner = np.repeat(np.arange(len(word)), lengths)
                if not len(word):
                    break
            at = np.flatnonzero(rank == least[owner])
            # of neighbouring hits every second one, from the left
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(new, nth, 0))) % 2 == 0]
            merged = np.bincount(owner[at], minlength=len(word))
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            symbols, rank, made, owner = symbols[keep], rank[keep], made[keep], owner[keep]
            lengths = lengths - merged
            starts = np.cumsum(lengths) - lengths
            near = np.zeros(len(symbols), bool)
            near[moved] = near[moved[moved > 0] - 1] = True
            touched = np.flatnonzero(near)
            paired = touched + 1 < len(symbols)
            paired[paired] = owner[touched[paired]] == owner[touched[paired] + 1]
            rank[touched[~paired]] = _NONE
            touched = touched[paired]
            rank[touched], made[touched] = self.pair(symbols[touched], symbols[touched + 1])
            last, several = least, merged > 1
        for w in sorted(exact):
            done[w] = np.array(self.in_order(first_symbols[first_begin[w] : first_begin[w] + first_lengths[w]].tolist()), np.int64)
        owner = np.concatenate([*out_word, *(np.full(len(s), w) for w, s in done.items()), np.zeros(0, np.int64)]).astype(np.int64)
        flat = np.concatenate([*out_symbol, *done.values(), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(first_lengths))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts without begin and end ids, offsets of the texts)."""
        texts = pc.replace_substring(texts, "▁", " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))
        data, offsets = bytes_of(texts)
        if len(data) == 0:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        space = data == 0x20
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.append(np.flatnonzero(new), len(data))
        of = np.searchsorted(begin, offsets)
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data.tobytes())]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        unique, where = bytes_of(coded.dictionary)
        points = np.frombuffer(unique.tobytes().decode().replace(" ", "▁").encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.concatenate(([0], np.cumsum((unique & 0xC0) != 0x80)))[where]
        symbols, counts = self.merge(self.symbol[points], np.diff(lead))
        raw = symbols >= self.size  # characters that are no piece become bytes
        if raw.any():
            owner = np.repeat(np.arange(len(counts)), counts)
            data = [chr(c - self.size).encode() for c in symbols[raw].tolist()]
            size = np.ones(len(symbols), np.int64)
            size[raw] = [len(x) for x in data]
            ids = np.repeat(symbols, size)
            ids[np.repeat(raw, size)] = self.byte_id[np.frombuffer(b"".join(data), np.uint8)]
            symbols, counts = ids, np.bincount(np.repeat(owner, size), minlength=len(counts))
        at = np.cumsum(counts) - counts
        per = counts[codes]
        return symbols[spans(at[codes], per)], np.concatenate(([0], np.cumsum(per)))[of]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids: the pieces in turn, with the dummy prefix taken off."""
        per = self.shown_at[ids + 1] - self.shown_at[ids]
        flat = self.shown[spans(self.shown_at[ids], per)].tobytes()
        ends = np.concatenate(([0], np.cumsum(per)))[offsets].tolist()
        texts = [flat[a + (flat[a : a + 1] == b" " and a < b) : b] for a, b in zip(ends[:-1], ends[1:])]
        try:
            flat.decode()
        except UnicodeDecodeError:  # ids of no text: bytes that make no character
            texts = [self.library.decode(ids[a:b].tolist()).encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return texts


def load(path: str) -> Model:
    return once(path, lambda: Model(path))


def with_ends(ids: np.ndarray, offsets: np.ndarray, bos: int, eos: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    out = np.empty(len(ids) + 2 * n, np.int64)
    shifted = offsets + 2 * np.arange(n + 1)
    inner = np.ones(len(out), bool)
    inner[shifted[:-1]] = inner[shifted[1:] - 1] = False
    out[inner] = ids
    out[shifted[:-1]], out[shifted[1:] - 1] = bos, eos
    return out, shifted


def _run(path: str, digest: bool, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for piece in pieces(batches, "text", 6 << 20):
            ids, offsets = with_ends(*model.encode(plain(piece, "text")), model.bos, model.eos)
            texts = model.decode(ids, offsets)
            keep = [piece.column(piece.schema.get_field_index(c)) for c in columns]
            if digest:
                raw = ids.astype("<u4").tobytes()
                shas = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                made = [pa.array(np.diff(offsets)), pa.array(shas), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                made = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array([x.decode() for x in texts])]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(keep + made, columns + names)

    return run


def encode_decode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, ids (with begin and end ids) and decoded text; with digest n_tokens, ids_sha256 and decoded_sha256 instead.

    A null text counts as empty: only the begin and end ids, decoded as the empty text. Rows are independent: repeated rows, null
    doc_ids and an empty table need no care, and other columns are not read.
    """
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(_run(path, digest, ["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {made}")
