"""Token ids of texts by a public byte-level BPE, encoded once per distinct piece of a batch.

A text may be cut before a single space between two characters that are not white space: the
tokenizer's own pattern never puts such a space inside a pre-token, and no special string holds
one.  The ids of the pieces, one after the other, are the ids of the text.  For the same reason distinct
pieces that meet at such a space are encoded as one text; the bytes that each id stands for tell whose it is.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crewmetrics.llm.words import buffers, text_column

#: bytes of pieces in one text for the tokenizer, and in one call
TEXT_BYTES, CALL_BYTES = 1 << 12, 1 << 17
#: pieces whose ids a worker holds for later texts, and the bytes of the longest
HELD_PIECES, HELD_BYTES = 1 << 18, 64
#: bytes of text whose distinct pieces are encoded together
ENCODED_BYTES = 8 << 20

_SPACE = 0x20
#: ASCII white space and separators; of the characters beyond, those of two bytes with lead C3-DF hold no white space
_UNSAFE = np.zeros(256, bool)
_UNSAFE[list(range(0x09, 0x0E)) + list(range(0x1C, 0x21))] = True


def _safe(data: np.ndarray) -> np.ndarray:
    """Where a piece may begin: a single space between two characters that are no white space."""
    space = np.flatnonzero(data[1:-1] == _SPACE) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    left, right = data[space - 1], data[space + 1]
    lead = data[np.maximum(space - 2, 0)]
    left_ok = (left < 0x80) & ~_UNSAFE[left] | (left >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
    right_ok = (right < 0x80) & ~_UNSAFE[right] | (right >= 0xC3) & (right <= 0xDF)
    return space[left_ok & right_ok]


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text and at each safe space."""
    cut = np.zeros(len(data) + 1, bool)
    cut[_safe(data)] = True
    cut[bounds] = True
    return np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)


class Encoder:
    """Ids of whole texts; one per Python worker."""

    _held: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: bytes that each id stands for: byte-level tokens have a character for each, added ones are literal
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        for number, token in self.library.get_added_tokens_decoder().items():
            self.sizes[number] = len(token.content.encode())
        self._forget()

    def _forget(self) -> None:
        self.held, self.held_ids, self.held_bounds = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _encoded(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that lie one after the other, and each piece's bounds in them."""
        joins = np.zeros(len(data) + 1, bool)
        joins[_safe(data)] = True
        alone = ~joins[starts] | (np.diff(starts // TEXT_BYTES, prepend=-1) > 0)
        edges, raw = np.append(starts[alone], len(data)).tolist(), data.tobytes()
        out, call, size = [np.zeros(0, np.uint32)], [], 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            call.append(raw[a:b].decode())
            size += b - a
            if size >= CALL_BYTES or b == len(data):
                out += [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(call, add_special_tokens=False)]
                call, size = [], 0
        ids = np.concatenate(out)
        ends = np.cumsum(self.sizes[ids])
        stops = np.append(starts[1:], len(data))[: len(starts)]
        after = np.searchsorted(ends, stops, "right")
        if len(starts) and not (after.all() and (ends[after - 1] == stops).all()):
            raise ValueError("the tokenizer's ids do not stand for the bytes of the text")
        return ids, np.concatenate((np.zeros(1, np.int64), after))

    def _distinct(self, cut: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all distinct pieces, each one's bounds in them, and the number of each piece."""
        coded = cut.dictionary_encode()
        data, bounds = buffers(coded.dictionary)
        return *self._encoded(data, bounds[:-1]), coded.indices.to_numpy(zero_copy_only=False)

    def _pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of some texts, and each text's bounds among them."""
        data, bounds = buffers(text_column(column))
        starts = _cuts(data, bounds)
        offsets = np.append(starts, len(data)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        return cut, np.searchsorted(starts, bounds)

    def lengths(self, column: pa.Array) -> np.ndarray:
        """How many tokens each text has."""
        cut, first = self._pieces(column)
        _, bounds, numbers = self._distinct(cut)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.diff(bounds)[numbers])))
        return total[first[1:]] - total[first[:-1]]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's bounds in them."""
        cut, first = self._pieces(column)
        out, bounds = self.ids_of_pieces(cut)
        return out, bounds[first]

    def ids_of_pieces(self, cut: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces (binary, none empty) in a row, and each piece's bounds in them."""
        ids, bounds, numbers = self._distinct(cut)
        each = np.diff(bounds)[numbers]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
        return ids[np.repeat(bounds[numbers] - total[:-1], each) + np.arange(total[-1])], total

    def ids_of_words(self, cut: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids_of_pieces``, for pieces that come again in later calls: the ids of short ones are held, found by their bytes."""
        coded = cut.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.held)
        fresh = coded.dictionary.filter(found.is_null())
        data, bounds = buffers(fresh)
        ids, first = self._encoded(data, bounds[:-1])
        place = found.fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.where(place < 0, len(self.held) + np.cumsum(place < 0) - 1, place)
        all_ids, edges = np.concatenate((self.held_ids, ids)), np.concatenate((self.held_bounds, self.held_bounds[-1] + first[1:]))
        numbers = place[coded.indices.to_numpy(zero_copy_only=False)]
        each = np.diff(edges)[numbers]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
        out = all_ids[np.repeat(edges[numbers] - total[:-1], each) + np.arange(total[-1])]

        short = np.diff(bounds) <= HELD_BYTES
        if len(self.held) + short.sum() > HELD_PIECES and 2 * len(fresh) > len(found):
            self._forget()  # other texts, other words
        short &= np.cumsum(short) <= HELD_PIECES - len(self.held)
        self.held = pa.concat_arrays([self.held, fresh.filter(pa.array(short))])
        self.held_ids = np.concatenate((self.held_ids, ids[np.repeat(short, np.diff(first))]))
        self.held_bounds = np.concatenate((self.held_bounds, self.held_bounds[-1] + np.cumsum(np.diff(first)[short])))
        return out, total
